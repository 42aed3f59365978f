import corpus_pipeline
from test_text_operators import brute_leaks, brute_lines, brute_sets, similar, texts

from meshwork.llm.util import Scratch, table

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs, scratch = table(spark, SF, "documents"), Scratch(spark, "t")
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(scratch.write(stage(spark, kept[-1], SF), f"s{i}"))
    for df in kept[:-1]:
        assert df.columns == docs.columns
    toxic, lines, near, clean, packed = kept[1:]
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    gone = {d for d, _ in texts(docs)} - {d for d, _ in texts(toxic)}
    assert gone and sum(labels.get(d, 1) for d in gone) >= 0.8 * len(gone)
    import hashlib

    assert {(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in texts(lines)} == {(d, h) for d, _, _, h in brute_lines(texts(toxic))}
    sets = brute_sets(texts(lines))
    left = {d for d, _ in texts(near)}
    for d, a in sets:
        assert (d in left) or any(e < d and similar(a, b) for e, b in sets) or any(similar(a, b) for e, b in sets if e != d)
    stay = [(d, s) for d, s in sets if d in left]
    assert not any(similar(a, b) for i, (_, a) in enumerate(stay) for _, b in stay[:i])
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    leaks = {d for d, _ in brute_leaks(texts(near), items)}
    assert {d for d, _ in texts(near)} - {d for d, _ in texts(clean)} == leaks
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {d for d, _ in texts(clean)}
