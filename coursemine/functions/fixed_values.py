"""Fixed values.

Everything in this file is a constant whose value decides results: word lists,
lookup tables, limits, message texts.  They are listed plainly so that the
expressions elsewhere can be read without them.
"""

# --- limits -----------------------------------------------------------------
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
MIN_CHUNK_CHARS = 20
PREVIEW_CHARS = 500
LEXICAL_CANDIDATES = 30
QUERY_TERM_LIMIT = 24
MAX_FORMULAS = 12
MAX_FORMULA_CHARS = 500
MAX_KEY_TERMS = 5
MAX_OUTLINE_ITEMS = 80
EMBED_DIMS = 384
BM25_K1 = 1.4
BM25_B = 0.75
# What a formula term of the request adds to a chunk that has it, and at most.
FORMULA_HIT, FORMULA_MOST = 1.2, 4.8
SUPPORTED_EXTENSIONS = ["pdf", "docx", "pptx", "txt", "md"]

# --- query tokens -------------------------------------------------------------
QUERY_STOPWORDS = [
    "a", "an", "and", "are", "as", "by", "for", "from", "in", "is", "of", "on",
    "or", "the", "to", "with", "怎么", "如何", "为什么", "一下", "讲解", "说明",
]
FORMULA_QUERY_STOPWORDS = [
    "begin", "cdot", "dfrac", "displaystyle", "dt", "dx", "dy", "dz", "end",
    "frac", "int", "left", "lim", "nabla", "partial", "right", "sqrt", "sum",
    "text",
]

# --- LaTeX cleaning -----------------------------------------------------------
LATEX_DROPPED = [
    "begin", "binom", "cdot", "cos", "cot", "csc", "det", "displaystyle",
    "dfrac", "end", "exp", "frac", "hline", "left", "max", "min", "mathrm",
    "qquad", "quad", "right", "sec", "sin", "tan", "text", "times", "to", "vec",
]
LATEX_SPOKEN = {
    "alpha": "alpha", "beta": "beta", "delta": "delta", "Delta": "Delta",
    "epsilon": "epsilon", "frac": "fraction", "gamma": "gamma",
    "Gamma": "Gamma", "ge": "greater than or equal",
    "geq": "greater than or equal", "infty": "infinity", "int": "integral",
    "lambda": "lambda", "Lambda": "Lambda", "le": "less than or equal",
    "leq": "less than or equal", "lim": "limit", "ln": "logarithm",
    "log": "logarithm", "mu": "mu", "nabla": "gradient", "neq": "not equal",
    "omega": "omega", "Omega": "Omega", "partial": "partial derivative",
    "phi": "phi", "pi": "pi", "prod": "product", "sigma": "sigma",
    "Sigma": "Sigma", "sqrt": "square root", "sum": "summation",
    "theta": "theta", "Theta": "Theta",
}
FORMULA_SPANS = [
    r"\$\$.*?\$\$",
    r"\\\[.*?\\\]",
    r"\\\(.*?\\\)",
    r"\$[^$\n]{2,400}\$",
]
MATH_SYMBOL_CLASS = r"[=\^_+\-*/<>|∫√∞≤≥≠≈∑∏∂∆∇±×÷]"

# --- key terms ----------------------------------------------------------------
TERM_STOPWORDS = [
    "a", "an", "and", "are", "as", "by", "for", "from", "in", "of", "on", "or",
    "left", "right", "that", "the", "there", "this", "to", "with",
]
FORMULA_WORDS = [
    "dx", "dy", "dz", "fraction", "over", "power", "subscript", "superscript",
]
FORMULA_LONE_WORDS = [
    "derivative", "gradient", "integral", "limit", "partial", "root", "square",
    "summation",
]
EXTRA_NOISE_WORDS = ["dt", "formula", "formulae"]
# concept, kind, bonus
CONCEPTS = [
    ("正项级数", "concept", 2.4),
    ("收敛级数", "concept", 2.3),
    ("发散级数", "concept", 2.3),
    ("幂级数", "concept", 2.1),
    ("级数", "concept", 1.8),
    ("收敛", "concept", 1.7),
    ("发散", "concept", 1.7),
    ("部分和", "concept", 2.1),
    ("通项", "concept", 1.6),
    ("比较判别法", "method", 2.5),
    ("比值判别法", "method", 2.4),
    ("根值判别法", "method", 2.4),
    ("判别法", "method", 1.8),
    ("极限", "concept", 1.8),
    ("导数", "concept", 1.8),
    ("偏导数", "concept", 2.0),
    ("积分", "concept", 1.8),
    ("曲线积分", "concept", 2.3),
    ("微分", "concept", 1.7),
    ("矩阵", "concept", 1.8),
    ("特征值", "concept", 2.2),
    ("概率", "concept", 1.8),
    ("方差", "concept", 1.8),
    ("line integral", "concept", 2.3),
    ("partial derivative", "concept", 2.3),
]
CONCEPT_SUFFIXES = [("判别法", "method", 1.8), ("定理", "theorem", 1.7), ("章", "chapter", 1.2), ("节", "chapter", 1.2)]
CJK_MARKERS = [
    "级数", "收敛", "发散", "部分和", "判别法", "极限", "导数", "积分", "微分",
    "矩阵", "特征值", "概率", "方差", "定理",
]
CJK_BAD_STARTS = "其这可因所明和为且则有由取当"
# longest first, as alternation order matters
CJK_NOISE = [
    "其部分和为", "部分和为", "这就表明", "这表明", "和为", "可见", "因此",
    "所以", "其中", "这时", "下面", "上面", "为",
]

# --- outlines -----------------------------------------------------------------
OUTLINE_HEADERS = ["目录", "目 录", "contents", "table of contents"]
OUTLINE_NOISE = ["copyright", "isbn", "http://", "https://", "www.", "目录"]
OUTLINE_NOISE_EXACT = ["contents", "table of contents"]
OUTLINE_BAD_LATEX = ["\\frac", "\\int", "\\sum", "$$", "\\begin"]
HEADING_WORDS = "章|节|篇|讲|Chapter|Section|绪论|引言|复习|习题|定理|积分|导数|级数|矩阵|概率|极限"

# --- plans, tasks, reviews ----------------------------------------------------
DEFAULT_TOPICS = [
    "进程与线程", "进程同步与互斥", "死锁", "内存管理", "虚拟内存", "文件系统",
    "I/O 与磁盘调度", "综合刷题与错题复盘",
]
LAST_DAY_TOPIC = "综合复盘与学习总结"
LAST_DAY_OBJECTIVE = "整合重点概念、错题和薄弱环节，完成一次综合检测或知识地图整理。"
PRACTICE_DAY_TOPIC = "综合练习与错题复盘"
PRACTICE_DAY_OBJECTIVE = "用练习暴露知识漏洞，沉淀错题原因和解题模板。"
# kind, share of the day, least minutes, title, description ({topic} is filled in)
TASK_TEMPLATES = [
    ("knowledge", 0.3, 20, "梳理「{topic}」核心概念", "阅读教材或课件，写下 3 个核心概念和 2 个易混点。"),
    ("practice", 0.38, 25, "完成「{topic}」专项练习", "完成 5-8 道相关题目，标记不确定题和错误原因。"),
    ("review", 0.18, 15, "整理错题与薄弱点", "把错题归因到概念不清、步骤遗漏或审题问题。"),
    ("recall", None, 10, "三句话复述今日知识", "不用看资料，用自己的话复述今日主题的核心逻辑。"),
]
# trigger (compared in lower case), weak points it adds
FEEDBACK_RULES = [
    (["pv", "信号量"], ["PV 操作", "信号量"]),
    (["死锁"], ["死锁判定"]),
    (["内存"], ["内存管理"]),
]
DEFAULT_WEAK_POINT = "知识点复述稳定性"
UNTITLED_TASK = "未完成任务"
# least rate, summary, suggestions
REVIEW_BANDS = [
    (0.85, "今天对「{topic}」推进顺利，可以进入下一主题，但仍建议保留少量错题复盘。",
     ["明天保留 20 分钟回看错题", "新知识学习后立即做小题验证"]),
    (0.5, "今天完成度中等，「{topic}」已有基础，但薄弱点还需要专项补强。",
     ["明天先补薄弱点再推进新内容", "把练习题按错误原因分类"]),
    (0.0, "今天执行压力偏大，「{topic}」建议降低新内容比例，先恢复节奏。",
     ["明天减少新知识输入", "任务拆得更短，每 25 分钟完成一个小目标"]),
]

# --- quizzes ------------------------------------------------------------------
META_QUESTION_MARKS = [
    "最应该先确认什么", "更合理的处理方式", "今天这个任务", "要掌握的核心内容",
    "只记录自己已经会", "跳过基础概念", "只看答案", "增加学习时长", "错题归因",
]
KEYWORD_SKIPS = ["应围绕", "说明", "核心", "概念", "关键", "步骤", "典型", "应用"]
SCORE_BANDS = [
    (80, "本次小测整体掌握较好，可以进入后续任务。"),
    (60, "本次小测基本达标，建议针对错误题回看相关知识点。"),
    (0, "本次小测暴露出薄弱点，建议先复习任务对应概念，再继续推进。"),
]
CHOICE_RIGHT = "回答正确。"
CHOICE_WRONG = "这一题需要回看标准选项对应的概念。"
SHORT_UNSCORED = "主观题暂不自动批改，请对照参考答案自查；需要模型判断时可点击 AI 批改。"
CHOICES_ONLY_SUMMARY = "已完成本地判题：客观题按标准答案判定，主观题仅展示参考答案。"
SHORT_FEEDBACK = [
    (80, "回答覆盖了主要意思，可以继续用题目巩固。"),
    (60, "回答基本相关，但还可以补充关键步骤或具体例子。"),
    (1, "回答还比较泛，需要回到任务主题补充核心概念。"),
    (0, "暂未作答。"),
]
GRADED_DEFAULT_FEEDBACK = "已完成批改。"

# --- conversations ------------------------------------------------------------
USEFUL_LINE_PATTERNS = [
    r"^#{1,4}\s+",
    r"^答案[:：]",
    r"^(第\d+题|题干|解析|结论|故答案|因此答案|注意|记忆方法)[:：]?",
    r"^\d+[.、]\s+",
    r"^[A-D][.、]",
    r"\\\(|\\\[|\$|\\frac|\\int|\\sum|\\partial|积分|公式|定理|答案",
]
HISTORY_HEADER = "【已压缩的聊天历史】"
HISTORY_COUNT = "原始消息数："
HISTORY_POINTS = "保留要点："
HISTORY_CUT = "【已截断】"
# intent, every group must have a hit, marker texts that precede a payload
INTENT_RULES = [
    ("insert", [["加入知识库", "写入知识库", "补充到知识库", "记到知识库"]]),
    ("adjust", [["调整"], ["计划", "明天", "后续"]]),
    ("read_page", [["当前页", "这一页", "这页", "PDF", "pdf", "阅读页"]]),
    ("review", [["复盘"]]),
    ("search", [["查一下", "检索", "知识库", "资料里"]]),
]
INSERT_MARKERS = ["加入知识库：", "写入知识库：", "补充到知识库：", "记到知识库："]
SESSION_TYPES = ["general", "goal", "plan", "pdf"]
SESSION_DEFAULT_TITLE = "新会话"

# --- jobs ---------------------------------------------------------------------
STAGE_RATIO = {
    "ocr_prepare": 0.05, "ocr_cached": 0.35, "chunking": 0.55, "parsing": 0.4,
    "extracting_outline": 0.62, "enriching": 0.7, "indexing": 0.88,
    "rag_ready": 1.0, "ocr_done": 0.52,
}
STAGE_RATIO_OTHER = 0.15
