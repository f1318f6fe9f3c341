"""Elements whose content is no text end where they end, and only they are left out."""

import pytest

from coursemine.llm import html_extraction


@pytest.mark.parametrize("inside, text", [
    ("one <svg/> two", "one two"), ("one <svg class='a>b' /> two <svg><text>no</text></svg> three", "one two three"),
    ("one <svg viewBox='0 0 1 1'><path d='M0'/></svg> two", "one two"),
    ("one <math/> two", "one two"), ("so <math><mi>x</mi><mo>=</mo><msup><mn>2</mn><mi>n</mi></msup></math> holds", "so x=2n holds"),
    ("<template-x>one</template-x>", "one"), ("<object-card>one</object-card>", "one"),
    ("one <template><p>no</p></template> two <script>x = '<p>'</script> three", "one two three"),
])
def test_raw_elements(inside, text):
    page = f"<html><body><article><p>{inside}</p><p>after</p></article></body></html>"
    assert html_extraction.main_blocks(page, None, None) == [text, "after"]
