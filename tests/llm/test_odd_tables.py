"""Every operator and stage over nulls, empty and long texts, ties, repeated rows, clashing columns, and empty tables."""

import pytest

from marlstone.llm import audio, decontam, language, neardup, packing, pii, suffix, tokens, toxicity, urls
from marlstone.llm.common import checkpointed, table

SF = "/root/testdata/sf0.001"
LONG = "Some long words of a text, ana@example.org and +49 30 1234567 beside them. " * 3000
TEXTS = [(1, "Plain words here."), (1, "Plain words here."), (2, None), (None, "no id"), (None, "no id"), (3, ""), (4, LONG), (5, LONG), (5, LONG), (6, "ana@example.org Zaphod"), (7, "\x1c  odd 🙂 <|endoftext|>"), (8, "- 1 -")]
EXTRA = {"id": "bigint", "key": "string", "score": "double", "predicted": "int", "evidence": "string", "hits": "bigint", "contaminated": "string", "base": "int", "terms": "string", "clean_text": "string", "url": "string", "u_url": "string", "best": "string",
         "edits": "string", "row": "int", "h": "string", "g": "int", "n": "int", "k1": "string", "label": "int", "l": "string", "spans": "int", "kept": "string", "component": "int", "host": "string", "ids": "string", "length": "string", "start": "string"}
VALUES = {"bigint": 7, "int": 3, "double": 0.5, "string": "mine"}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), *[VALUES[k] for k in EXTRA.values()]) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` {k}" for c, k in EXTRA.items())).repartition(3)


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.learn(spark.createDataFrame([(i, f"words number w{i % 3} " + "grob" * (i % 2)) for i in range(20)], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"))


def bench(spark):
    return spark.createDataFrame([(1, "Plain words here."), (2, None), (None, "x"), (3, "")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda spark, df, model: toxicity.score_documents(df, model),
    "toxicity_learn": lambda spark, df, model: toxicity.score_documents(df, toxicity.learn(df, df.selectExpr("doc_id", "row AS toxic"))),
    "pii": lambda spark, df, model: pii.sanitise_documents(df),
    "audio": lambda spark, df, model: audio.text_as_audio(df),
    "language": lambda spark, df, model: language.identify(df, language.learn(df)),
    "decontamination": lambda spark, df, model: decontam.contamination(df, bench(spark)),
    "urls": lambda spark, df, model: urls.filter_urls(df, urls.rules_frame(spark, [("block", "net", "/")])),
    "neardup": lambda spark, df, model: neardup.near_duplicates(df),
    "suffix": lambda spark, df, model: suffix.remove_repeats(df),
    "tokens": lambda spark, df, model: tokens.apply_edits(tokens.count_tokens(df)),
    "packing": lambda spark, df, model: packing.pack_documents(df),
}
KEEPS = {"toxicity": {"score", "predicted", "evidence"}, "pii": {"base", "terms", "clean_text"}, "decontamination": {"hits", "contaminated"}, "urls": {"host", "path", "rule", "verdict"}}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, odd, model, name):
    got = OPERATORS[name](spark, odd, model)
    rows = got.collect()
    if name == "packing":
        assert {r.doc_id for r in rows if r.start == 0} == {i for i, _ in TEXTS} and sum(r.start == 0 for r in rows) == len(TEXTS)
    else:
        assert len(rows) == len(TEXTS) and sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    by: dict = {}
    for r in rows:  # repeated rows have equal results
        if name != "packing" and r.doc_id in (1, 5):
            assert by.setdefault(r.doc_id, r) == r
    if name in KEEPS:
        own = [c for c in odd.columns if c not in KEEPS[name]]
        before = sorted(str(tuple(r)) for r in odd.select(*own).collect())
        assert sorted(str(tuple(r[c] for c in own)) for r in rows) == before
    empty = OPERATORS[name](spark, odd.limit(0), model)
    assert empty.count() == 0 and empty.columns == got.columns


def test_results_for_odd_rows(spark, odd, model):
    found = {r.doc_id: r for r in decontam.contamination(odd, bench(spark)).collect()}
    assert [i for i, r in found.items() if r.contaminated] == [1]
    marked = {r.doc_id: r for r in pii.sanitise_documents(odd).collect()}
    assert marked[2].clean_text is None and "@" not in marked[4].clean_text and marked[3].clean_text == ""
    near = {r.doc_id: r.component_id for r in neardup.near_duplicates(odd).collect()}
    assert near == {None: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    rest = {r.doc_id: r.n_removed for r in suffix.remove_repeats(odd).collect()}
    assert rest[5] == len(LONG) and 0 < rest[4] < len(LONG) and rest[1] == 0
    named = {r.doc_id: r.lang_pred for r in language.identify(odd, language.learn(odd)).collect()}
    assert {i for i, x in named.items() if x == "und"} == {2, 3, 8}


def test_stages_keep_the_callers_columns(spark, odd):
    import corpus_pipeline

    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in docs.collect()}
        docs = checkpointed(stage(spark, docs, SF))
        assert docs.dtypes == odd.dtypes, name
        rows = docs.collect()
        assert all(r[c] == VALUES[k] for r in rows for c, k in EXTRA.items()), name
        if name in ("toxicity", "decontamination"):
            assert {(r.doc_id, r.text) for r in rows} == before
        if name == "near_dedup":
            assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 6, 7, 8}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {None, 1, 2, 3, 4, 6, 7, 8}


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline

    none = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0
