"""Each operator on null, empty, long and repeated rows, with extra columns whose names its own plan uses."""

import random
from collections import Counter

import pytest

from kerbside.llm.decontamination import contaminated
from kerbside.llm.mixing import mix_sources, mixed_documents
from kerbside.llm.ngram_jaccard import ngram_components
from kerbside.llm.pii import personal_report
from kerbside.llm.quality_classifier import quality_scores
from kerbside.llm.quality_rules import quality_rules
from kerbside.llm.secret_scan import secret_report
from kerbside.llm.token_output import token_index
from kerbside.llm.toxicity import toxic_passages
from kerbside.llm.warc import archive_pages

CLASHING = ("df", "n", "label", "key", "size", "target", "unit", "kept", "file", "row", "base", "spans", "runs", "start", "score", "held_out", "component_id", "rep", "f0")
_rng = random.Random(31)
PROSE = [" ".join(_rng.choice(["lora", "temin", "suva", "pelar", "nomi", "karun"]) + _rng.choice("aeiou") for _ in range(70)) for _ in range(30)]
LONG = "lora temin suva " * 60_000
ROWS = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(PROSE)]
ROWS += [(0, PROSE[0], "en", "s0"), (0, PROSE[0], "en", "s0")]
ROWS += [(100, None, None, None), (101, "", "", ""), (102, " \t\n\x0b\f\r", "en", "s1"), (103, LONG, "de", "s1"), (104, "x" * 400_000, "de", "s1"), (105, " é\x00 日本", "ja", None)]
NO_ID = [(None, "no id here", "en", "s0"), (None, None, None, None)]


@pytest.fixture(scope="module")
def tables(spark):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING)
    docs = spark.createDataFrame([(*r, *([7] * len(CLASHING))) for r in ROWS + NO_ID], schema)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2, 1) for i in range(30)] + [(None, 1, 1, 1), (3, None, None, 1), (4, 5, 5, 1)], "doc_id long, quality int, toxic int, text int")
    bench = spark.createDataFrame([(1, PROSE[3], 1), (1, PROSE[3], 1), (None, PROSE[4], 1), (3, None, 1), (4, "", 1)], "item_id long, text string, doc_id int")
    return docs, labels, bench


def of_rows(frame, names):
    """Results by doc_id; equal rows must have equal results in the named columns."""
    by, count = {}, Counter()
    for r in frame.collect():
        count[r.doc_id] += 1
        value = tuple(r[n] for n in names)
        if r.doc_id is not None:
            assert by.setdefault(r.doc_id, value) == value
    assert count == Counter(r[0] for r in ROWS + NO_ID)
    return by


def test_components(tables):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(tables[0]).collect()}
    assert set(got) == {r[0] for r in ROWS}
    assert got[100] == (0, 100) and got[101] == (0, 101) and got[102] == (0, 102) and got[103] == (3, 103) and got[104] == (1, 104)


def test_mixing(tables):
    got = of_rows(mix_sources(tables[0]), ("size", "taken"))
    assert got[100] == got[101] == got[102] == (0, 0) and got[103][0] == 180_000
    assert mixed_documents(tables[0]).columns == tables[0].columns


def test_classifiers(tables):
    docs, labels, _ = tables
    quality = of_rows(quality_scores(docs, labels), ("score", "predicted"))
    toxic = of_rows(toxic_passages(docs, labels), ("score", "predicted"))
    for got in (quality, toxic):
        assert all(0 <= s <= 1 for s, _ in got.values()) and got[100] == got[101] == got[102]
    assert of_rows(toxic_passages(docs, labels.limit(0)), ("score",))


def test_spans(tables):
    for report in (secret_report, personal_report):
        got = of_rows(report(tables[0]), ("base_sha256", "spans"))
        assert got[100] == got[101] and got[100][1] == ""


def test_archive(spark):
    rows = [(1, None, None, 1, "a", "b"), (1, None, None, 1, "a", "b"), (2, "u", "", 1, "a", "b"), (None, "v", "z", 1, "a", "b"), (3, "w", "q" * 2_000_000, 1, "a", "b")]
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, page int, digest string, keeper string")).collect())
    assert got == [(0, 1, "response", None), (1, 0, "revisit", 2), (1, 0, "revisit", 2), (2, 0, "response", None), (3, 2_000_000, "response", None)]


def test_token_output(tables):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    got = token_index(tables[0], public_tokenizers.path("word_bpe_49k.json")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS + NO_ID)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert {r.n_tokens for r in got if r.doc_id in (100, 101, 102)} <= {1, 2}


def test_decontamination(tables):
    docs, _, bench = tables
    got = Counter((r.doc_id, r.item_id) for r in contaminated(docs, bench).where("score = 1").collect())
    assert got == Counter({(3, 1): 2, (4, None): 1})


@pytest.mark.parametrize("alone", ["lora", "漢" * 700_000])
def test_decontamination_of_runs_shorter_than_a_seed(spark, alone):
    bench = spark.createDataFrame([(1, PROSE[3])], "item_id long, text string")
    one = spark.createDataFrame([(1, alone)], "doc_id long, text string")
    assert contaminated(one, bench).collect() == []
    two = spark.createDataFrame([(1, alone), (2, PROSE[3]), (3, "漢" * 700_000), (4, "lora")], "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.item_id, r.score) for r in contaminated(two, bench).collect()] == [(2, 1, 1.0)]


def test_quality_rules(tables):
    got = of_rows(quality_rules(tables[0]), ("n_words", "base_failed", "kept"))
    assert got[100] == got[101] == got[102] == (0, True, False) and got[103] == (180_000, True, False)
    assert all(got[i][2] for i in range(30))
