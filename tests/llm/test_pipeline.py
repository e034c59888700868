"""The corpus pipeline against brute force, stage by stage on what the stage before kept."""

import random

import corpus_pipeline as p
from jobloom.llm import toxicity
from tests.llm import helpers as h

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = p.read(spark, SF, "documents")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]

    kept = p.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    model = toxicity.train(docs, p.read(spark, SF, "labels"))

    def odds(text):
        text = text.lower()
        return max([model.word_score(t) for t in text.split()] + [model.spaced_score(text)])

    pairs = [(i, t) for i, t in pairs if model.score(odds(t)) < toxicity.THRESHOLD]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in pairs)

    single = p.one_per_group(spark, kept, SF)
    assert single.columns == docs.columns
    first = {i: c for i, _, c in h.near_classes(pairs)}
    pairs = [(i, t) for i, t in pairs if first[i] == i]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, _ in pairs)

    clean = p.drop_contaminated(spark, single, SF)
    assert clean.columns == docs.columns
    items = [(r["item_id"], r["text"]) for r in p.read(spark, SF, "benchmark").collect()]
    bad = {r[0] for r in h.contamination(pairs, items) if r[-1]}
    pairs = [(i, t) for i, t in pairs if i not in bad]
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in pairs)

    cut = p.cut_secrets(spark, clean, SF)
    assert cut.columns == docs.columns
    texts = dict(pairs)
    for r in cut.collect():
        assert r["n_chars"] == len(r["text"])
        pieces = r["text"].split("[SECRET]")
        at = 0
        for piece in pieces:  # what stays is the original text, in order
            at = texts[r["doc_id"]].index(piece, at) + len(piece)
        assert len(pieces) > 1 or r["text"] == texts[r["doc_id"]]
    assert cut.count() == len(pairs)

    mixed = p.mix(spark, cut, SF).collect()
    after = {r["doc_id"]: r for r in cut.collect()}
    assert mixed and all(r.asDict() == {**after[r["doc_id"]].asDict(), "copies": r["copies"]} and r["copies"] > 0 for r in mixed)

    whole = p.run(spark, SF)
    assert h.by_id(whole.collect()) == h.by_id(mixed)


def test_odd_rows_and_clashing_columns(spark):
    docs = h.documents(spark, h.odd_rows())
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[5:] == h.CLASHING
    assert 0 < docs.count() < len(h.odd_rows())
    mixed = p.mix(spark, docs, SF)
    assert mixed.columns == [*docs.columns, "mix_copies"] and 0 < mixed.count() <= docs.count()
    for _, stage in p.STAGES:
        assert stage(spark, h.documents(spark, []), SF).count() == 0


def test_mixing_keeps_texts_of_null_and_repeated_ids(spark):
    rows = [(None, "one two three"), (None, "four five"), (7, "six seven eight"), (7, "nine ten"), (8, None)]
    got = [(r["doc_id"], r["text"]) for r in p.mix(spark, h.documents(spark, rows), SF).collect()]
    assert got and len(set(got)) == len(got) and set(got) <= set(rows)


def test_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(5)
    words = h.vocabulary(rng)
    a, b, c, d = (h.sentence(rng, 60, words) for _ in range(4))
    item = p.read(spark, SF, "benchmark").filter("length(text) > 100").first()["text"]
    # Two groups of null ids, one with exact repeats of its smallest id, and a clean text beside each bad row of the same id.
    rows = [(None, a), (None, a + " more"), (None, b), (None, item), (1, c), (1, c), (1, d), (2, c + " more"), (2, item), (3, b), (None, None), (None, None)]
    docs = h.documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/rows.parquet")
    for df in (docs, p.read(spark, str(tmp_path), "rows")):
        single = p.one_per_group(spark, df, SF)
        assert single.columns == df.columns
        kept = [(r["doc_id"], r["text"]) for r in single.collect()]
        group_a = [r for r in kept if r[1] in (a, a + " more")]
        assert len(group_a) == 1 and group_a[0][0] is None
        assert sorted((r for r in kept if r not in group_a), key=str) == sorted([(1, c), (1, d), (2, item), (3, b), (None, None), (None, None)], key=str)
        clean = [(r["doc_id"], r["text"]) for r in p.drop_contaminated(spark, df, SF).collect()]
        assert sorted(clean, key=str) == sorted((r for r in rows if r[1] != item), key=str)
