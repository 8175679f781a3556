"""Layouts of pages, and passwords in addresses, that went wrong before."""

import random
import re

import pytest

from docmill.llm import html_text, secrets

BODY = "<h1>Sea wall</h1><p>The sea came up the wall on Monday, higher than before.</p><p>Nobody had seen it so high, said the keeper.</p>"
TEXT = "Sea wall\nThe sea came up the wall on Monday, higher than before.\nNobody had seen it so high, said the keeper."
LAYOUTS = {
    "names that end in what they are": f'<body><div class="main-nav"><a href=/>Home and all</a></div><main><div class="main-menu"><ul><li><a>News of today</a></li></ul></div>{BODY}</main><div class="page-footer">Copyright Foo Ltd and more words</div></body>',
    "a sidebar in the content": f'<body><div class="content"><div class="content-sidebar"><p>Most read stories of this week are here</p></div>{BODY}</div></body>',
    "comments as a list after it": f'<body><article>{BODY}</article><ul><li class="comment">I like it very much indeed, thanks.<li class="comment">Me too, and my family also.</ul></body>',
    "comments as a list in it": f'<body><article>{BODY}<ol><li class="comment"><p>I like it very much indeed, thanks.</p></li></ol></article></body>',
    "an advert as a paragraph": f"<body><article>{BODY.replace('</h1>', '</h1><p class=advert>Buy shoes now<p>', 1)}</article></body>",
    "an advert within a line": f'<body><article>{BODY.replace("Monday,", "Monday, <span class=ad>buy <b>our</b> <span>shoes</span> now</span>")}</article></body>',
    "choices and labels": f"<body><article>{BODY}<select name=x><option>Red<option>Green</select><label>Your name</label></article></body>",
    "a teaser by name": f"<body><article class=teaser><h2>Other</h2><p>Short words of another story.</p></article><article>{BODY}</article></body>",
    "a teaser without a name": f"<body><article><h2>Other</h2><p>Short story.</p></article><article>{BODY}</article></body>",
    "a header of the article": f'<body><article><div class="entry-header">{BODY[:17]}</div>{BODY[17:]}</article></body>',
    "names that say what is not there": f'<body><div class="no-menu layout-with-sidebar"><div class="has-ad">{BODY}</div></div></body>',
    "a heading called header": f'<body><article>{BODY.replace("<h1>", "<h1 class=page-header>")}</article></body>',
    "inline names of the author's text": f'<body><article>{BODY.replace("wall on", "<a class=social-link>wall</a> on").replace("keeper", "<b class=tag>keeper</b>")}</article></body>',
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    assert html_text.main_text(LAYOUTS[layout]) == TEXT


def test_tables_keep_their_header_rows():
    page = f'<body><article>{BODY}<table><tr class="header"><th>A<td>B<tr><td>1<td>2</table></article></body>'
    assert html_text.main_text(page) == f"{TEXT}\nA\nB\n1\n2"


def test_the_scan_finds_the_best_run_of_blocks():
    """Against all runs: of the best ones, whatever the weights, the scan's has the same sum."""
    rng, words = random.Random(6), {"p": 1.0, "q": -1.0, "r": 0.4}
    for _ in range(60):
        kinds = [rng.choice("pqr") for _ in range(rng.randint(1, 12))]
        weights = {f"word:{k}": w for k, w in words.items()}
        page = "".join(f"<div>{' '.join([k] * rng.randint(1, 5))}</div>" for k in kinds)
        values = [v for what, _, text, _ in html_text.tokens(page) if what == "text" for v in [sum(words[x] for x in text.split())]]
        real = html_text.tokens
        try:
            html_text.tokens = lambda p, real=real: ((w, f"word:{t.split()[0]}" if w == "text" else k, t, a) for w, k, t, a in real(p))
            got = html_text.main_text(page, weights | {k: 0.0 for _, k, _, _ in html_text.tokens(page) if k.startswith("tag:")})
        finally:
            html_text.tokens = real
        best = max([0.0, *(sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1))])
        assert abs(sum(words[x] for x in got.split()) - best) < 1e-9


def test_many_open_elements_take_no_long():
    assert html_text.main_text("<b>" * 100_000 + "</i>" * 100_000) == "" and html_text.main_text("<div class=x><span>" * 50_000 + "end") in ("", "end")


def scanned_by_hand(text):
    """Base spans, then weak ones, with Python's own expressions where these allow what the patterns need."""
    base = [m.span() for m in re.finditer(secrets.ASSIGN, text, re.A) if len(m[2]) >= 6] + [m.span() for p in (secrets.ACCESS, secrets.HEX) for m in re.finditer(p, text)]
    inside = lambda s, spans: any(a < s[1] and b > s[0] for a, b in spans)
    address = [s for m in re.finditer(secrets.IN_ADDRESS, text) if not inside(s := m.span(1), base)]
    weak = [s for m in re.finditer(secrets.WEAK, text, re.A) if not inside(s := m.span(), base + address)]
    parts = [[m.span() for m in re.finditer(p, text, re.A)] for p in (secrets.IDENTIFIER, secrets.ENDPOINT)]
    near = lambda w, ps: any(a <= w[1] + secrets.SCOPE and b >= w[0] - secrets.SCOPE for a, b in ps)
    return sorted({w for w in weak + address if all(near(w, p) for p in parts)})


def test_linked_spans_equal_a_scan_by_hand(spark):
    """Candidates, identifiers and endpoints as plain expressions find them; names of any length in addresses."""
    rng = random.Random(21)
    parts = ["user=bob", "login: anna", "https://h.example/x", "host=db1", "0123456789abcdef0", "pwd=hunter22", "postgres://bob:hunter22secret@db.example", f"ftp://{'n' * 45}:pass-word-1@h.example", "s3://u:deadbeef01234567x@b.c",
             "AKIA" + "B" * 16, "token=abcdefgh", "aB3" * 12, "words and words " * 7, "http://a:b@c", "x://:secret99@h"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(150)] + [f"ftp://{'n' * 45}:pass-word-1@h.example", "", None]
    found = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: scanned_by_hand(t or "") for i, t in enumerate(texts)}
    assert {i: [tuple(x) for x in r.linked] for i, r in found.items()} == want
    assert want[150] == [(52, 63)] and sum(map(len, want.values())) > 80
