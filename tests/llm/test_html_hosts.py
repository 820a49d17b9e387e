"""Boilerplate of a host: every page counts, copies count once, blocks agree."""

import random

SCHEMA = "page_id long, url string, html string"
MENU = "Acme daily news about everything local and global since 1901"
NOTE = "Sign up for our letter and get the news of the day by post"


def line(r, k=40):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(k))


def texts(spark, rows):
    from strata.llm.html_text import extract

    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_articles_go_through_the_array(spark):
    r = random.Random(1)
    own = [line(r) for _ in range(6)]
    quote = line(r, 12)
    rows = [(k, "http://a.example/", f"<article><h2>In short</h2><p>{t}</p><p>{NOTE}</p><p>{NOTE} {t}</p></article>") for k, t in enumerate(own)]
    rows += [(10 + k, "http://b.example/", f"<article><p>{t}</p><p>{quote if k < 2 else t}</p></article>") for k, t in enumerate(own)]
    got = texts(spark, rows)
    for k, t in enumerate(own):  # whole blocks go, parts of a block and short headings stay
        assert got[k] == f"In short {t} {NOTE} {t}"
        assert got[10 + k] == f"{t} {quote if k < 2 else t}"


def test_blocks_agree_with_one_array(spark, monkeypatch):
    from strata.llm import html_text

    r = random.Random(2)
    rows = []
    for k in range(60):
        menu = f"<div>{MENU}</div>" if k % 5 < 3 else ""  # three in five bodies
        rare = f"<div>{NOTE}</div>" if k % 5 == 4 else ""  # one in five
        rows.append((k, f"http://a.example/{k}", f"<body>{menu}<p>{line(r)}</p>{rare}<p>The end of it {line(r, 9)}</p></body>"))
    rows += [(100 + k, "http://a.example/c", rows[0][2]) for k in range(30)]
    whole = texts(spark, rows)
    assert not any(MENU in t for t in whole.values()) and sum(NOTE in t for t in whole.values()) == 12
    assert len({whole[0], *(whole[100 + k] for k in range(30))}) == 1
    for size in (4000, 700):  # several blocks, then hardly two bodies in one
        monkeypatch.setattr(html_text, "GROUP_BYTES", size)
        assert texts(spark, rows) == whole
        assert texts(spark, rows[::-1]) == whole


def test_copies_and_quotes_stay(spark):
    r = random.Random(3)
    story, phrase = line(r), "as was said by all of them on the day"
    rows = [(k, f"http://a.example/?{k}", f"<body><p>{story}</p></body>") for k in range(4)]
    rows += [(4, "http://a.example/print", f"<article><p>{story}</p></article>")]
    own = [line(r) for _ in range(8)]
    rows += [(10 + k, "http://b.example/", f"<body><p>{t} {phrase if k < 2 else ''} {t}</p></body>") for k, t in enumerate(own)]
    got = texts(spark, rows)
    assert {got[k] for k in range(5)} == {story}
    for k, t in enumerate(own):
        assert got[10 + k] == (f"{t} {phrase} {t}" if k < 2 else f"{t} {t}")


def test_hosts_against_sets(spark, monkeypatch):
    from strata.llm import html_text
    from tests.llm.brute import page_texts

    for seed in range(3):
        r = random.Random(100 + seed)
        pool = [line(r, k) for k in (2, 4, 6, 9, 10, 11, 14, 25)]
        pages = []
        for k in range(50):
            parts = [r.choice(pool) if r.random() < 0.6 else line(r, r.choice((3, 8, 20))) for _ in range(r.randrange(7))]
            parts = [f"{line(r, 2)} {p}" if r.random() < 0.2 else p for p in parts]
            inner = "".join(f"<p>{p}</p>" for p in parts)
            inner = r.choice((f"<article>{inner}</article>", f"<div>{inner}</div>", f"<nav>{pool[-1]}</nav><div>{inner}</div>"))
            host = r.choice(("a.example", "a.example", "b.example", ""))
            pages.append((host, r.choice((None, "", *[f"<body>{inner}</body>"] * 12))))
        rows = [(k, f"http://{host}/{k}" if host else None, html) for k, (host, html) in enumerate(pages)]
        want = dict(enumerate(page_texts(pages)))
        for group, bundle in ((8 << 20, 16 << 20), (3000, 1), (900, 2000)):
            monkeypatch.setattr(html_text, "GROUP_BYTES", group)
            monkeypatch.setattr(html_text, "BUNDLE_BYTES", bundle)
            assert texts(spark, rows) == want
