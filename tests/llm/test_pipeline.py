import corpus_pipeline
from dinesight.llm.common import read_table
from .test_ngram_join import brute as classes
from .test_quality_rules import brute as base_rules
from .test_suffix_dedup import brute as cut

SF = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    quality = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        after = docs.collect()
        ids = {r["doc_id"] for r in after}
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "quality_rules":
            for r in before:
                if base_rules(r["text"])[-1]:
                    assert r["doc_id"] not in ids
                elif quality.get(r["doc_id"]) == 1:
                    assert r["doc_id"] in ids
            # With so few documents the ratio is shrunk; larger tables reject all junk.
            junk = [r["doc_id"] for r in before if quality.get(r["doc_id"]) == 0]
            assert sum(d not in ids for d in junk) >= 0.5 * len(junk)
        elif name == "ngram_join":
            assert sorted(ids) == sorted({c for _, _, c in classes([(r["doc_id"], r["text"]) for r in before], 5, 80)}) and len(after) == len(ids)
        elif name == "suffix_dedup":
            assert len(after) == len(before)
            want = {r["doc_id"]: n - removed for r, (n, removed, _, _) in zip(before, cut([r["text"] for r in before], corpus_pipeline.REPEATED_BYTES), strict=True)}
            assert all(0 <= want[r["doc_id"]] - len(r["text"].encode()) <= 8 and r["n_chars"] == len(r["text"]) for r in after)
        elif name == "mixing":
            assert 1.2 < sum(len(r["text"].split()) for r in after) / sum(len(r["text"].split()) for r in before) < 1.8
        else:
            assert len(after) == len(before) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in after)
