"""Main text by one rule on hosts of every size."""

import random

import pytest

from assayer.llm import html

rng = random.Random(12)
VOCABULARY = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(3000)]


def words(n):
    return " ".join(rng.choices(VOCABULARY, k=n)).capitalize() + "."


def page(kind, number):
    """HTML and its main text: an article in the dress that ``kind`` says, among a menu, a one-off advert and a footer."""
    lead, first, second, title = words(20), words(60), words(30), words(5)
    menu = f'<div class="m-{number % 2}"><a href="/a">Home</a> <a href="/b">{words(1)}</a></div><nav>skip</nav>'
    advert = f'<div class="advert">{words(40)}</div><div class="sidebar promo"><p>{words(40)}</p></div>'
    foot = f'<footer>{words(30)}</footer><div class="cookie-notice">{words(25)}</div>'
    body = {
        "parts": (f'<h1>{title}</h1><div class="part one"><p>{first}</p></div>{advert}<div class="part two"><p>{second}</p></div>', [title, first, second]),
        "lead": (f'<h1>{title}</h1><div class="lead">{lead}</div>{advert}<div class="body"><p>{first}</p><p>{second}</p></div>', [title, lead, first, second]),
        "continued": (f"<article><h1>{title}</h1><p>{first}</p></article>{advert}<section><p>{second}</p></section>", [title, first, second]),
        "two": (f"<article><h1>{title}</h1><p>{first}</p></article>{advert}<article><p>{second}</p></article>", [title, first, second]),
    }[kind]
    return f"<html><head><title>x</title></head><body>{menu}<div class=\"wrap\">{body[0]}</div>{foot}</body></html>", "\n".join(body[1])


KINDS = ["parts", "lead", "continued", "two"]


@pytest.mark.parametrize("kind", KINDS)
def test_one_page_alone(kind):
    source, text = page(kind, 0)
    got = html.main_text(source, "h")
    menu = "" if kind in ("continued", "two") else got.split("\n")[0] + "\n"
    assert got == menu + text  # a short menu without a telling name can't be told from a lead on a page without a marked article


def test_hosts_of_every_size_give_the_same_text(spark):
    made = {k: [page(k, i) for i in range(600)] for k in KINDS}
    rows, expected = [], {}
    for n in (1, 4, 6, 600):
        for k in KINDS:
            for i in range(n):
                rows.append((len(rows), f"http://{k}-{n}.example.com/{i}", made[k][i][0]))
                expected[len(rows) - 1] = (k, n, made[k][i][1])
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)).collect()}
    for i, (k, n, text) in expected.items():
        mine = got[i]
        if k in ("parts", "lead") and n < html.LEAST_PAGES:  # the unnamed menu can only be counted on more pages
            mine = mine.split("\n", 1)[1]
        assert mine == text, (k, n, i)


def test_template_with_changing_words_still_goes(spark):
    rows = [(i, f"http://h.example.com/{i}", f'<div class="tease"><a href="#">{words(3)}</a> <a href="#">{words(4)}</a></div><div class="x"><p>{words(50)}</p></div>') for i in range(8)]
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("\n" not in r["text"] and len(r["text"].split()) == 50 for r in got)
