import compare
import corpus_pipeline
import llm_fixtures as fx
import pytest
import test_llm_linededup
import test_llm_packing
import test_llm_secrets
import test_llm_simhash
from tokenizers import Tokenizer

from brisktill.llm import linededup, secrets
from brisktill.llm.oracles import ORACLES
from brisktill.llm.tokens import tokenizer_path
from brisktill.sources.staging import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run_equal_brute_force(spark, folder):
    """Each stage on its predecessor's rows, against the brute force of its operator."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: tuple(r) for r in docs.select(COLUMNS).collect()}
    by_name, results = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, folder))
        assert docs.columns == COLUMNS
        results[name] = {r["doc_id"]: tuple(r) for r in docs.collect()}
        assert len(results[name]) == docs.count()

    sql = compare.connect(folder).execute(ORACLES["op1_quality_rules"]).fetchall()
    rows = {r[0]: rows[r[0]] for r in sql if r[-1]}
    assert results["quality_rules"] == rows

    dedup = {}
    for i, dropped, text in test_llm_linededup.brute([r[:2] for r in rows.values()]):
        if not dropped:
            dedup[i] = rows[i]
        elif text.split():
            dedup[i] = (i, text, *rows[i][2:4], len(text))
    assert results["line_dedup"] == dedup and any(dedup[i] != rows[i] for i in dedup)

    prints = [(i, test_llm_simhash.brute_print(r[1])) for i, r in dedup.items()]
    first = test_llm_simhash.brute_components(prints)
    rows = {i: dedup[i] for (i, _), c in zip(prints, first, strict=True) if i == c}
    assert results["simhash_near_dedup"] == rows

    redacted = {}
    for i, r in rows.items():
        spans = test_llm_secrets.brute(r[1])
        starts = {(m.start(), m.end()): m.start(2) for m in test_llm_secrets.ASSIGN.finditer(r[1])}
        whole = [(a, k, b, starts[a, b] if k == 0 else a) for a, k, b in spans]
        text = secrets.redacted(r[1], whole)
        redacted[i] = (i, text, *r[2:4], len(text))
    assert results["secret_scan"] == redacted and any(redacted[i][1] != rows[i][1] for i in rows)

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    packed = by_name["packing"](spark, docs, folder).collect()
    test_llm_packing.check(packed, [r[:2] for r in redacted.values()], library)
    whole = corpus_pipeline.run(spark, folder).collect()
    same = lambda found: sorted((r["doc_id"], r["start"], r["doc_tokens"]) for r in found if r["start"] == 0)
    assert same(whole) == same(packed)
    test_llm_packing.check(whole, [r[:2] for r in redacted.values()], library)


def test_clean_documents_come_through_unchanged(spark, frame):
    texts = [fx.prose(1000 + i, 150) for i in range(30)]
    texts += [texts[0], texts[1] + " more", "### $$$ " * 40, "same words again " * 50]
    docs = frame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], fx.SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, None))
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i: left.get(i) for i in range(30)} == dict(enumerate(texts[:30]))
    assert not {30, 32, 33} & left.keys()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_bear_awkward_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = fx.clashing(fx.awkward(spark))
    found = stage(spark, docs, None)
    if name != "packing":
        assert found.columns == docs.columns
    assert found.count() > 0
    assert stage(spark, fx.empty(spark), None).count() == 0


def test_least_lengths_are_what_the_readme_says():
    assert (linededup.DEPTH, linededup.LEAST_TOKENS) == (8, 5)
