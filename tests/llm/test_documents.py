"""Near-duplicates, personal data, contamination, quality, sharding and pages against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from driftlens.llm.cluster import stored
from driftlens.llm import decontamination, html_text, near_duplicates, pii, quality_classifier, sharding

R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 9))) for _ in range(900)]
prose = lambda n, seed: " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def shingle_set(t):
    w = (t or "").split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def edited(text, n, seed):
    w, r = text.split(), random.Random(seed)
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return " ".join(w)


def corpus():
    base = [prose(120, k) for k in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[0]) for k in range(30)]  # exact copies
    rows += [(200 + k, edited(base[1], 2, k)) for k in range(90)]  # near copies, over a block
    rows += [(400 + k, prose(60, 900 + k) + " " + prose(55, 5)) for k in range(20)]  # a shared passage, not near
    rows += [(500, None), (501, ""), (502, "one two"), (503, "one two"), (504, " \n "), (None, base[0]), (600, base[2]), (600, base[2])]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)  # groups and buckets over it are compared block by block
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.near_duplicates(docs).where("doc_id is not null").collect())
    known = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent, links = list(range(len(known))), [0] * len(known)
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(known)):
        for b in range(a):
            x, y = known[a][1], known[b][1]
            if x and y and len(x & y) / len(x | y) >= 0.8:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(known):
        least[find(k)] = min(i, least.get(find(k), i))
    assert got == sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(known))
    assert near_duplicates.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_group_makes_a_row_for_each_text(spark, monkeypatch):
    """5,000 near copies and as many of a text that they hardly differ from: the steps' tables stay linear, the counts exact."""
    base, loose = prose(700, 1), prose(60, 2)
    rows = [(k, f"{base} {prose(4, 70_000 + k)}") for k in range(2500)] + [(10_000 + k, edited(loose, 1, k)) for k in range(2500)]
    written = []
    monkeypatch.setattr(near_duplicates, "stored", lambda df, what: written.append((what, out := stored(df, what))) or out)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == (0, 2499) for k in range(2500))  # settled by distance
    sets = [shingle_set(t) for _, t in rows[2500:]]
    for k in range(0, 2500, 97):
        assert got[10_000 + k][1] == sum(len(sets[k] & s) >= 0.8 * len(sets[k] | s) for s in sets) - 1
    sizes = {}
    for what, df in written:
        sizes[what] = max(sizes.get(what, 0), df.count())
    assert all(n <= 32 * len(rows) for what, n in sizes.items() if what in ("near-members", "near-pivots-edges")), sizes
    assert all(n <= 4 * len(rows) for what, n in sizes.items() if what not in ("near-members", "near-pivots", "near-pivots-edges", "near-all-edges")), sizes


def test_null_ids_link_nothing(spark):
    got = near_duplicates.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(None, None, 0)] * 2


def test_pruning_keeps_pairs_at_the_threshold():
    least = near_duplicates.least_matches()
    assert all(m <= 0.8 * n for n, m in enumerate(least.tolist()) if n) and least[160] > 80


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    r = random.Random(5)
    texts = ["a@b.c_d@e.f é 1.2.3.4.5.6.7.8 +49 (123) 456-78.9 4111 1111 1111 1111", "", None, "4785380592391139x" * 300, "1" * 20_000 + " a" * 3, "x" * 50_000 + "@", "é@a.b 300.1.1.1 0001.02.3.4 +1234567 +12345678", "\U0001f600 +1 (23) 45-67-89\n4111-1111-1111-1111"]
    texts += ["".join(r.choice("ab1239.@+- ()é\n") for _ in range(r.randint(1, 300))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {x.doc_id: x for x in pii.report(docs).collect()}
    for i, t in enumerate(texts):
        own = spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in own) for k in PLAIN]
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[i].spans.startswith(joined)


def test_pii_disclosing_terms(spark):
    rows = [(k, f"word{k} the Zanzibar office of the boss@firm.com wrote and the rest is filler{k}") for k in range(4)] + [(10 + k, f"the weather of the day {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    at = rows[0][1].index("Zanzibar")
    assert f"term:{at}:{at + 8}" in got[0] and "term" not in got[10]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and clean[0].startswith("word0 the [TERM]") and clean[10] == rows[4][1]


def test_pii_empty(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination(spark):
    items = [(k, prose(15 + 4 * k, 50 + k) + ".") for k in range(12)] + [(90, None), (91, " "), (None, prose(20, 999))]
    rows = [(k, prose(400, 700 + k)) for k in range(40)] + [(500, None), (501, ""), (502, "short")]
    for k in range(12):
        rows.append((100 + k, prose(90, 300 + k) + " " + items[k][1] + " " + prose(150, 400 + k)))
        rows.append((200 + k, prose(33, 500 + k) + " " + edited(items[k][1], max(1, len(items[k][1].split()) // 10), k).upper() + " " + prose(70, 600 + k)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("best_share", F.lit(0)), bench).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        assert got[100 + k].item_ids == [k] and got[200 + k].item_ids == [k]
    assert not any(got[i].contaminated for i, _ in rows if i < 100 or i >= 500)
    assert decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0


def test_longest_common_subsequence():
    a = "a b c d e f".split()
    assert decontamination.common(decontamination.places(a), 6, "x a c b d f".split()) == 4
    assert decontamination.common(decontamination.places(a), 6, []) == 0


def test_quality(spark):
    good = [(k, prose(60 + k % 50, k), "en", f"s{k % 3}") for k in range(200)]
    bad = [(1000 + k, " | ".join(prose(40, 7000 + k).upper().split()) + "!!", "en", f"s{k % 3}") for k in range(60)]
    toxic = [(2000 + k, prose(50, 8000 + k) + " idiot moron " + prose(9, k), "en", "s1") for k in range(60)]
    odd = [(None, prose(60, 1), None, None), (5000, None, "en", "s1"), (5000, None, "en", "s1")]
    docs = spark.createDataFrame(good + bad + toxic + odd, "doc_id long, text string, lang string, source string").withColumn("host", F.lit("clash"))
    labels = [(i, 1, 0) for i, *_ in good[::2]] + [(i, 0, 0) for i, *_ in bad[::2]] + [(i, 1, 1) for i, *_ in toxic[::2]] + [(1, None, 0), (None, 1, 1), (0, 1, 0)]
    rows = quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(good + bad + toxic + odd)
    kept = {r.doc_id: r.kept for r in rows}
    assert sum(kept[i] for i, *_ in good[1::2]) >= 98  # rows without labels
    assert sum(kept[i] for i, *_ in bad[1::2]) == 0 and sum(kept[i] for i, *_ in toxic[1::2]) <= 1
    none = quality_classifier.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.where("not kept").count() == 0
    assert quality_classifier.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_sharding(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "SMALLEST", 2000)
    monkeypatch.setattr(sharding, "TARGET", 60_000)
    docs = spark.createDataFrame([(k, prose(100, k), k % 3) for k in range(400)] + [(None, None, None), (1, "x", 1), (1, "x", 1)], "doc_id long, text string, arrival int").repartition(6)
    store = sharding.compacted(docs, 8, str(tmp_path / "store"))
    back = store.read()
    assert back.columns == docs.columns and back.exceptAll(docs).count() == 0 and docs.exceptAll(back).count() == 0
    assert not sharding.plan(store.shards()) and len(store.shards()) < 48 and max(s.bytes for s in store.shards()) < 3 * sharding.TARGET
    version = store.versions()[-1]
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit([], version - 1)
    assert store.versions()[-1] == version
    assert sharding.compacted(docs.limit(0), 2, str(tmp_path / "empty")).read().count() == 0


def test_pages(spark):
    body = lambda *p: "".join(f"<p>{x}</p>" for x in p)
    side = '<nav><ul><li><a href="/">Home page of all</a></li></ul></nav><div class="sidebar">Side words of no use</div><div class="cookie-notice">We use cookies</div>'
    rest = '<section id="comments"><p>A reader writes a rather long comment here, longer than the article even.</p></section><form><p>Subscribe now</p></form><footer>&copy; us</footer>'
    page = lambda *p: f"<html><head><title>t</title><style>p{{}}</style></head><body>{side}<div class='post post-12'><h1>A &amp; B</h1>{body(*p)}<script>var a='<p>no</p>'</script></div>{rest}</body></html>"
    rows = [(k, "http://h.org/a", page(f"First  long\n paragraph number {k} of words", "Second <b>part</b>&nbsp;here<br>and there")) for k in range(5)]
    rows += [(9, "http://h.org/short", page("Tiny.")), (10, None, None), (11, "bad url", ""), (12, "http://other.org", "<p>plain <i>text<p>more"), (9, "http://h.org/short", page("Tiny."))]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert got[3].text == "A & B\n\nFirst long paragraph number 3 of words\n\nSecond part here and there"
    assert got[9].text == "A & B\n\nTiny." and got[9].n_chars == len(got[9].text)
    assert got[10].text == "" and got[11].text == "" and got[12].text == "plain text\n\nmore"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
