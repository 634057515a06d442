from cellframe.llm.html_text import parse


def test_letters_that_grow_in_lower_case_do_not_move_the_end_of_a_script():
    page = "<p>" + "İstanbul " * 30 + "</p><script>var a = '<p>';</SCRIPT><p>first words of the article</p><style>p {}</style ><p>İ last words</p>"
    texts = [n.text.strip() for n in parse(page) if n.text is not None]
    assert texts == [("İstanbul " * 30).strip(), "first words of the article", "İ last words"]


def _texts(page):
    return [n.text for n in parse(page) if n.text]


def test_a_head_ends_at_the_first_element_or_text_of_the_body():
    assert _texts("<head><title>x</title><meta charset=utf-8><style>p {}</style><p>First paragraph</p>") == ["First paragraph"]
    assert _texts("<head><title>x</title>\n  Bare text<p>more</p>") == ["Bare text", "more"]
    assert _texts("<html><head>\n<script>a</script>\n</head>\n<body><p>body</p></body></html>") == ["body"]


def test_an_open_drawing_ends_at_a_block_and_an_object_is_ordinary():
    assert _texts("<p>before</p><svg><path d=1><text>label</text><p>after the drawing</p>") == ["before", "after the drawing"]
    assert _texts("<p>before</p><svg><text>label</text></svg><p>after</p>") == ["before", "after"]
    assert _texts("<p>a</p><object data=x><p>fallback</p></object><p>b</p>") == ["a", "fallback", "b"]
