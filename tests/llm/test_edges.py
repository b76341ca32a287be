"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from quernel.llm import exact_dedup, licenses, line_dedup, mixing, packing, pii, quality, secrets, simhash, token_counts

from .helpers import CLASHES, SCHEMA, odd

PER_ROW = {
    "mixed": lambda d: mixing.mixed(d), "pii": lambda d: pii.personal_data(d), "quality": quality.quality, "exact": exact_dedup.exact_dedup,
    "tokens": token_counts.token_counts, "prefixes": token_counts.prefix_index, "licenses": licenses.license_scan,
    "secrets": secrets.secrets, "simhash": simhash.near_duplicates,
}
FILTERS = {"quality": quality.filtered, "lines": line_dedup.line_dedup, "simhash": simhash.deduplicated, "mixing": mixing.repeated}


@pytest.fixture(scope="module", autouse=True)
def small_model():
    """A quickly trained model will do here."""
    p = pii.fit(640, 8, 1)
    kept, pii.trained = pii.trained, lambda: p
    yield
    pii.trained = kept


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_each(spark, name):
    docs = odd(spark)
    out = PER_ROW[name](docs)
    assert out.count() == docs.count()
    assert PER_ROW[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_same_columns(spark, name):
    docs = odd(spark)
    out = FILTERS[name](docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[c] == f"c{k}" for r in got for k, c in enumerate(CLASHES))
    assert FILTERS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing(spark):
    got = packing.pack(odd(spark)).collect()
    assert {(r.doc_id, r.start, r.length, r.doc_tokens) for r in got if r.doc_id in (1, 2, 3)} == {(k, 0, 1, 1) for k in (1, 2, 3)}
    assert sum(r.length for r in got if r.doc_id is None) == sum(r.doc_tokens for r in got if r.doc_id is None and r.start == 0)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_dedup_verdicts(spark):
    got = {(r.doc_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd(spark)).collect()}
    assert {(5, 3, False), (6, 3, True), (None, 3, False), (1, 3, False), (2, 3, True), (7, 2, True)} <= got


def test_simhash_zero_and_null_ids(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd(spark)).collect() if r.doc_id is not None}
    assert got[1] == got[2] == got[3] == ("0" * 16, 1)
    assert got[5][1] == got[6][1]
    stay = simhash.deduplicated(odd(spark)).collect()
    assert sum(r.doc_id is None for r in stay) == 2 and sum(r.doc_id == 7 for r in stay) <= 1


def test_line_dedup_texts(spark):
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(odd(spark)).collect()}
    assert got[1] is None and got[2] == "" and got[3] == " \n\t \n"
    assert got[11] == "same line here\n"
    assert len([r for r in line_dedup.line_dedup(odd(spark)).collect() if r.doc_id == 7]) == 2


def test_mixing_takes_nothing_of_empty_texts(spark):
    got = [r for r in mixing.mixed(odd(spark)).collect() if r.m_size == 0]
    assert got and all(r.m_taken == 0 for r in got)


def test_quality_of_nothing(spark):
    got = {r.doc_id: r for r in quality.quality(odd(spark)).collect()}
    assert got[1].base_failed and not got[1].kept and got[1].n_words == 0
    assert got[4].n_words == 60_000
