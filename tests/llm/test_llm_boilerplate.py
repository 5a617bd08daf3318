from newsloom.llm.boilerplate import body_lines, line_parts, line_text, main_text, title_words

SCHEMA = "url string, title string, content string, parts string, line string"
MENU = "Home\nWorld\nOpinion"
FOOT = "About us | Contact | Terms\n© 2025 {site}. All rights reserved. No part may be reproduced."


def page(i, city, site="a", extra=""):
    body = "\n".join(f"The harbour board of sector {k} discussed repair number {i}{k} at length, and the mayor of {city} asked everyone for patience until the end of the month." for k in range(3))
    return (f"https://{site}.example/{i}", f"{city}: board discusses repairs", f"{MENU}\n{city}: board discusses repairs\n{body}\nSubscribe to our letter today.\nRead next\nOtherburg{i}: council delays plan\nThe council of Otherburg{i} delayed its plan again on Monday.\n{FOOT.format(site=site)}{extra}", "x", "y")


def test_line_text_and_parts():
    assert line_text("<p class='x'>A &amp; b</p>") == "A & b"
    assert [p for p, _ in line_parts("Home · World  (12) Share: Mail")] == ["home", "world", "share", "mail"]
    assert title_words("Ab Port 迪帕图") == {"port", "迪帕", "帕图"}


def test_body_is_found(spark):
    rows = [page(i, f"Town{chr(97 + i % 26)}{chr(97 + i // 26)}ville") for i in range(40)]
    got = {}
    for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.url, []).append(r.line_no)
    assert len(got) == 40 and all(sorted(v) == [4, 5, 6] for v in got.values())


def test_markup_cues():
    content = '<nav>\n<li><a href="/">Home page</a></li>\n</nav>\n<h1>Portville: board meets</h1>\n<p>The board of Portville met on Monday and discussed the repairs of the old harbour wall at length.</p>\n<p class="teaser">A teaser about something else that happened elsewhere last week in some detail.</p>\n<ul>\n<li>Portville will pay half of the sum, and the owners of the warehouses the other half in two years</li>\n</ul>\n<footer>\n<p>Contact the editors of this paper by mail.</p>\n</footer>'
    assert body_lines("Portville: board meets", content, set(), set()) == [4, 7]


def test_edges(spark):
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "A sentence about Portville that goes on. " * 20_000
    rows = [("u1", None, None, "", ""), ("u2", "t", "", "", ""), (None, "t", "text", "", ""), ("u3", "", "Home\nWorld", "", ""), ("u4", None, long, "", ""), ("u4", None, long, "", "")]
    assert [(r.url, r.line_no) for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()] == [("u4", 0)]
