"""Text after an open head or an embedded element without an end is kept, and what they hold is judged by the trees."""

import pytest

from locavec.llm.html_extract import Page, extract_texts, learn

MORE = " ".join(["The rest of the article goes on with plain words, and it has some sentences."] * 3)


def seen(h):
    return [s for _, s in Page(h).segments]


def test_open_head_ends_at_the_first_text():
    h = "<html><head><title>t</title><meta charset=x><style>p{}</style><article><p>main text, and more of it.</p></article>"
    assert seen(h) == ["main text, and more of it."] and extract_texts([h], learn()) == ["main text, and more of it."]
    assert seen("<head><script>var a = '<p>'</script><link rel=x></head><body><p>b</p>") == ["b"]


@pytest.mark.parametrize("name", ["button", "select", "object", "svg", "math", "canvas", "audio", "video", "template", "noscript"])
def test_element_without_an_end_closes_with_its_parent(name):
    h = f"<body><article><p>The first words of a text, which go on. <{name}>x</p><p>{MORE}</p><p>{MORE}</p></article>"
    p = Page(h)
    assert [p.tag[i] for i, _ in p.segments] == ["p", name, "p", "p"] and p.end[p.tag.index(name)] == p.tag.index(name) + 1
    assert extract_texts([h], learn())[0].endswith(f"{MORE}\n\n{MORE}")


@pytest.mark.parametrize("name", ["svg", "object"])
def test_nested_elements_end_at_their_own_end(name):
    p = Page(f"<p>a <{name}>b <{name}>c</{name}> d</{name}> e</p>")
    assert [(p.tag[i], s) for i, s in p.segments] == [("p", "a"), (name, "b"), (name, "c"), (name, "d"), ("p", "e")]
    assert [r for r, _ in p.runs] == [p.runs[0][0]] * 5


def test_content_is_judged_and_the_block_goes_on():
    h = f"<body><article><h1>A title of the page</h1><p>{MORE} Here f(<math><mi>x</mi><mo>=</mo><mn>1</mn></math>) holds.</p><p>{MORE}</p></article>"
    assert extract_texts([h], learn())[0] == f"A title of the page\n\n{MORE} Here f(x=1) holds.\n\n{MORE}"
    h = f"<body><article><p>{MORE}</p><noscript><p>{MORE}</p></noscript><p>{MORE}</p></article>"
    assert seen(h) == [MORE] * 3
