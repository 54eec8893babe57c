"""Licences that differ in a word, and pages whose text is of medium length, linked, or oddly named."""

import time

import pytest
from corvane.llm import license_scan
from corvane.llm.html_extract import main_text

SCANNER = license_scan.Scanner(license_scan.TEMPLATES, license_scan.GRAM, license_scan.WINDOW, license_scan.BAND, license_scan.COVERAGE)
NOTICES = {n: t for n, t in license_scan.TEMPLATES.items() if n.endswith("GPL-3.0-notice") or n.endswith("GPL-2.1-notice") or n == "GPL-2.0-notice"}

LINES = {
    "Released under the BSD License.": [],
    "Released under the Apache License, Version 2.0.": ["Apache-2.0"],
    "This work is licenced under the GNU General Public License, version 3.": ["GPL-3.0"],
    "Released under the MIT License.": ["MIT"],
    "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    "This work is licensed under the GNU Lesser General Public License, version 3.": [],
    "This work is licensed under the GNU General Public License, version 2.": [],
    "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
    "Licensed under CC BY 3.0.": [],
    "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"],
    "Licensed under the Boost Software License, Version 1.0.": [],
}


@pytest.mark.parametrize("line", LINES)
def test_lines_name_their_own_licence_or_none(line):
    assert [m[0] for m in SCANNER.scan(f"Some words before. {line} And some after.")] == LINES[line]


@pytest.mark.parametrize("name", NOTICES)
def test_notices_name_their_own_licence_or_none(name):
    assert [m[0] for m in SCANNER.scan(NOTICES[name])] == [name]
    for other in ("4", "1.3"):  # a version that has no template
        own = NOTICES[name].replace("version 2.1", f"version {other}").replace("version 2 ", f"version {other} ").replace("version 3", f"version {other}")
        assert SCANNER.scan(own) == []
    assert [m[0] for m in SCANNER.scan(NOTICES[name].replace("program", "game").replace("library", "game"))] == [name]


PARAGRAPHS = [f"This is paragraph {w} of the page and it has just the words that one would expect to see in it, not many more." for w in ("one", "two", "three")]
NAV = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About us</a></li></ul>"
ZH = ["北京是中华人民共和国的首都，位于华北平原的北部，是全国的政治和文化中心，历史十分悠久。", "这座城市有许多著名的古迹，每年都有来自世界各地的游客前来参观，人口超过两千万。"]


def paragraphs(parts):
    return "".join(f"<p>{p}</p>" for p in parts)


@pytest.mark.parametrize("size", [1, 2, 3])
@pytest.mark.parametrize("article", [True, False])
def test_paragraphs_of_medium_length_come_back_whole(article, size):
    parts = [p * size for p in PARAGRAPHS]
    inner = "<h1>A title</h1>" + paragraphs(parts)
    page = f"<body>{NAV}{'<article>' + inner + '</article>' if article else '<div>' + inner + '</div>'}<footer><p>Copyright of the site and all that is in it</p></footer></body>"
    assert main_text(page) == "\n".join(["A title", *parts])


def test_pages_without_stop_words():
    assert main_text(f"<body>{NAV}{paragraphs(ZH)}</body>") == "\n".join(ZH)


def test_linked_headings_and_lines_within_an_article_stay_and_menus_go():
    page = f"<article><h1><a href=x>Linked title</a></h1><p>{PARAGRAPHS[0]}</p><p><a href=r>See the whole report</a></p><p>{PARAGRAPHS[1]}</p>{NAV}</article>"
    assert main_text(page) == "\n".join(["Linked title", PARAGRAPHS[0], "See the whole report", PARAGRAPHS[1]])


@pytest.mark.parametrize("name", ["search", "meta", "legal", "side search-2"])
def test_doubtful_names_within_an_article_keep_prose_alone(name):
    page = f'<article><p>{PARAGRAPHS[0]}</p><section class="{name}"><p>{PARAGRAPHS[1]}</p><p>By A. Writer</p></section></article>'
    assert main_text(page) == "\n".join(PARAGRAPHS[:2])
    assert main_text(f'<body><div class="{name}"><p>{PARAGRAPHS[1]}</p></div><article><p>{PARAGRAPHS[0] * 3}</p></article></body>') == PARAGRAPHS[0] * 3


def test_a_single_notice_between_menus_is_no_article():
    page = f"{NAV}<p>We use these to make the site work for you and for us, as you can see in the terms of it.</p>{NAV}"
    assert main_text(page) == ""


def test_unmatched_closing_tags_cost_nothing():
    page = "<div>" * 3000 + paragraphs(PARAGRAPHS) + "</b></i>" * 50_000
    began = time.perf_counter()
    assert main_text(page) == "\n".join(PARAGRAPHS)
    assert time.perf_counter() - began < 3
