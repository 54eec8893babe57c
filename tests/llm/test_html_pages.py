"""Pages that mark up their article in other ways than the test data."""

import pytest
from corvane.llm.html_extract import main_text

PROSE = "This is the text of a page and it has all the words that one would expect of it in an article of this kind. " * 3
CZECH = "Praha leží uprostřed Čech na řece Vltavě, kde stojí starobylý hrad, mnoho kostelů, paláců, mostů také rozlehlých zahrad. " * 3
PAGES = {
    "comments as articles": (f"<div><p>{PROSE}</p></div><article class='comment'><p>I think that it is wrong.</p></article>", PROSE),
    "teasers as articles": (f"<div><p>{PROSE}</p></div><article><a href=x>One more of the day</a></article>", PROSE),
    "class of a post": (f"<body class='has-sidebar header-fixed'><article class='post tag-news'><p>{PROSE}</p></article></body>", PROSE),
    "other language": (f"<body><div><a href=x>Domů</a></div><p>{CZECH}</p></body>", CZECH),
    "remark alone": (f"<article class='comment'><p>{PROSE}</p></article>", PROSE),
}


@pytest.mark.parametrize("name", PAGES)
def test_article_is_found(name):
    page, want = PAGES[name]
    assert main_text(page) == want.strip()
