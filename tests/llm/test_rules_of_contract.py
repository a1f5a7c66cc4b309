"""Cases where markup, spans, manifests and bands are easily got wrong."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from driftlens.llm import html_text, pii, quality_rules, sharding


def blocks(source):
    return [t for _, t in html_text.Page(source).kept()]


@pytest.mark.parametrize(
    "source, want",
    [
        ('<script>var a="<!--";</script><p>Hello</p><nav>menu</nav><p>x</p>', ["Hello", "x"]),
        ("<script>if(i<n) // don't\n</script><p>A</p><p>it's</p>", ["A", "it's"]),
        ('<article><h1 class="post-header">T</h1><p class="related-text">R</p><p class="advert">no</p><div class="comments"><p>c</p></div></article>', ["T", "R"]),
        ("<p>1 < 2 & 3 > 2 <b>x</b></p>", ["1 < 2 & 3 > 2 x"]),
        ('<p title="a>b">T</p><p data-x=\'">\'>U', ["T", "U"]),
        ("<!-- x <p>no</p>", []),
        ("", []),
        ("x <p", ["x <p"]),
    ],
)
def test_markup(source, want):
    assert blocks(source) == want


@pytest.mark.parametrize("unit", ['<a "', '<a b="x>y" ', "<", "</", "<div>", '<p class="a>', "<b></section>"])
def test_broken_markup_takes_linear_time(unit):
    begin = time.process_time()
    html_text.Page(unit * 100_000).scores()
    assert time.process_time() - begin < 20


class Plain(HTMLParser):
    """A reader of well-formed pages: paragraphs and headings of the article."""

    def __init__(self):
        super().__init__()
        self.inside, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1"):
            self.out.append("")
        if tag == "br" and self.out:
            self.out[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and self.out:
            self.out[-1] += data


def test_pages_against_a_plain_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        reader = Plain()
        reader.feed(r.html or "")
        assert got[r.page_id] == "\n\n".join(t for x in reader.out if (t := " ".join(x.split())))


def test_an_article_keeps_blocks_outside_of_the_winning_path(spark):
    usual = "<html><body><article><div class='part'><p>%s</p></div></article></body></html>"
    odd = "<html><body><article><div class='part'><p>first part here, which is longer</p></div><div class='more'><p>second part</p></div></article></body></html>"
    rows = [(k, "http://h.org", usual % f"text number {k} of this host") for k in range(9)] + [(9, "http://h.org", odd)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "first part here, which is longer\n\nsecond part" and got[3] == "text number 3 of this host"


def test_sanitised_text_is_built_from_the_spans(spark):
    rows = [(k, f"email contact joe@corp.example about é{k} +1 202 555 0147 4111 1111 1111 1111 at 10.0.0.7 term") for k in range(5)]
    rows += [(10, "nothing"), (11, None), (12, ""), (13, "me@a.example " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for i, t in rows:
        t = t or ""
        found = sorted((int(a), int(b), f"[{k.upper()}]") for k, a, b in (x.split(":") for x in spans[i].split(",") if x))
        merged = []
        for a, b, k in found:
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
            else:
                merged.append((a, b, k))
        want, at = "", 0
        for a, b, k in merged:
            want, at = want + t[at:a] + k, b
        assert out[i] == want + t[at:]
    assert "[EMAIL]" in out[0] and "joe" not in out[0] and "[[" not in out[0]


def store_of(spark, tmp_path, name):
    return sharding.ShardStore(spark, str(tmp_path / name))


def test_a_commit_in_between_is_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "SMALLEST", 500)
    store = store_of(spark, tmp_path, "store")
    rows = lambda a, n: spark.createDataFrame([(k, f"text {k}" * 9) for k in range(a, a + n)], "doc_id long, text string")
    store.append(rows(0, 80).repartition(4), F.lit(0))
    other, plan = store_of(spark, tmp_path, "store"), sharding.plan
    calls = []

    def plan_then_other_writes(shards):
        if not calls:
            calls.append(1)
            other.append(rows(1000, 10).coalesce(1), F.lit(5))
        return plan(shards)

    monkeypatch.setattr(sharding, "plan", plan_then_other_writes)
    before = store.versions()[-1]
    old = store.read([s.file for s in store.shards(before)])
    assert store.compact() > 0
    assert store.read().count() == 90 and store.read().distinct().count() == 90
    assert old.count() == 80  # readers of an older version still find its shards
    store.vacuum(keep=1)
    assert store.read().count() == 90


def test_a_dead_writers_claim_is_taken_over(spark, tmp_path, monkeypatch):
    store = store_of(spark, tmp_path, "dead")
    store._fs.createNewFile(store._path("manifests/v00000001.claim"))
    with pytest.raises(sharding.Conflict):
        store.commit([], 0)
    monkeypatch.setattr(sharding, "LEASE", -1)
    store.append(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), F.lit(None))
    assert store.read().count() == 2


def test_bands_reject_what_the_language_is_not(spark):
    r = random.Random(4)
    words = {x: ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(300)] for x, letters in (("en", "abcdefgh"), ("xx", "опрстуфх"))}
    rows = [(k, lang, " ".join(r.choices(words[lang], k=120))) for lang in words for k in range(60)]
    odd = ["".join(chr(r.randrange(33, 126)) for _ in range(6)) for _ in range(120)]
    rows = [(k, lang, t) for k, (_, lang, t) in enumerate(rows)] + [(500, "en", " ".join(odd)), (501, "en", rows[70][2]), (502, "xx", " ".join(odd)), (503, "en", " ".join(r.choices(words["en"], k=120)))]
    kept = {x.doc_id: x.kept for x in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert not kept[500] and not kept[501] and not kept[502] and kept[503]
    assert sum(kept[k] for k in range(120)) >= 114
    one = spark.createDataFrame([(1, None, "a b"), (2, None, None)], "doc_id long, lang string, text string")
    assert [x.kept for x in quality_rules.quality_rules(one).collect()] == [False, False]  # all fail the plain rules
