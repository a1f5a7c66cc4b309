"""Terms that stand far from the entity that they disclose."""

from driftlens.llm import pii


def test_terms_at_any_distance_and_length(spark):
    far = " ".join(f"filler{k}" for k in range(30))
    rows = [(k, f"Zanzibar office {far} boss@firm.com {far} Qx {k}") for k in range(4)] + [(10 + k, f"office {far} of the day {k}") for k in range(200)]
    rows += [(300, "the boss of Zanzibar"), (301, "mail me@here.org from Timbuktu"), (302, "mail me@here.org from Timbuktu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for k in range(4):
        assert clean[k] == f"[TERM] office {far} [EMAIL] {far} [TERM] {k}"
    assert clean[10] == rows[4][1] and clean[300] == rows[-3][1]
    assert clean[301] == "mail [EMAIL] from Timbuktu"  # one text, fewer than SUPPORT
