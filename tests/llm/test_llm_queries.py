import os

import oracle
import pytest

queries = pytest.importorskip("readroute.llm.queries")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def _intervals(spark, got):
    assert ((0 < got.low) & (got.low <= got.high) & (got.high <= got.total)).all() and set(got.assay) == {"gex", "atac"}


def _unmatched(spark, got):
    found = queries.QUERIES["p4_ties"](spark, SF).filter("ties <> 1").count()
    assert got.n_rows.sum() == found and (got.ties != 1).all() and got.suggestion.isna().equals(got.ties == 0)


def _counts(spark, got):
    assert ((got.low <= got.estimate) & (got.estimate <= got.high)).all() and set(got.kind) == {"day", "cb", "group", "union"}


def _ids(spark, got):
    from tokenizers import Tokenizer

    from readroute.llm import bpe

    tokenizer = Tokenizer.from_file(bpe.VOCABULARY)
    tokenizer.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in table(spark, "documents").select("doc_id", "text").collect()}
    assert len(got) == len(texts)
    for doc, ids in zip(got.doc_id, got.ids):
        assert list(ids) == tokenizer.encode(texts[doc], add_special_tokens=False).ids, doc


def _selection(spark, got):
    caps = {(r.mix, r.source): r.max_repeats for r in table(spark, "mix_targets").collect()}
    assert not got.duplicated(["mix", "doc_id"]).any()
    assert all(1 <= n <= caps[m, s] for m, s, n in zip(got.mix, got.source, got.repeats))


def _shares(spark, got):
    assert {(m, s) for m, s in zip(got.mix, got.source)} == {(r.mix, r.source) for r in table(spark, "mix_targets").collect()}
    assert ((got.groupby("mix").actual_share.sum() - 1).abs() < 1e-9).all()


def _scores(spark, got):
    assert len(got) == table(spark, "documents").count()
    kinds = got[["insult", "threat", "hate", "sexual"]]
    assert ((0 <= got.score) & (got.score <= 1) & (kinds.max(axis=1) <= got.score + 1e-9)).all()


def _found(spark, got):
    from readroute.llm import toxicity

    scored = queries.QUERIES["p10_scores"](spark, SF).toPandas()
    assert set(got.doc_id) == set(scored.doc_id[scored.score >= toxicity.CASE])


def _rates(spark, got):
    assert got.n_docs.sum() == table(spark, "documents").count() and ((got.rate - got.n_flagged / got.n_docs).abs() < 1e-9).all()


#: What must hold of the results that have no SQL.
CHECKS = {
    "p3_intervals": _intervals, "p4_unmatched": _unmatched, "p7_counts": _counts, "p8_ids": _ids, "p9_selection": _selection, "p9_shares": _shares,
    "p10_scores": _scores, "p10_found": _found, "p10_rates": _rates,
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLES:
        oracle.compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF)
    else:
        CHECKS[name](spark, queries.QUERIES[name](spark, SF).toPandas())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_unions_of_many_groups(spark, tmp_path):
    tags = os.path.join(SF, "gex_tags.parquet")
    os.symlink(tags, tmp_path / "gex_tags.parquet")
    n = 103
    named = spark.sql(f"SELECT DISTINCT cb AS barcode FROM parquet.`{tags}` WHERE cb IS NOT NULL").selectExpr("barcode", f"dense_rank() OVER (ORDER BY barcode) % {n + 1} AS k")
    named.selectExpr("barcode", f"CASE WHEN k < {n} THEN concat('g', k) END AS grp").write.parquet(str(tmp_path / "barcode_lookup.parquet"))
    got = queries.p7_counts(spark, str(tmp_path)).collect()
    groups = {r.name: r.estimate for r in got if r.kind == "group"}
    unions = {r.name: r.estimate for r in got if r.kind == "union"}
    # The group without a name is counted, but has no partner.
    assert len(groups) == n + 1 and len(unions) == n * (n - 1) // 2 + 1
    assert all(max(groups[x] for x in u.split("+")) <= e * 1.0000001 for u, e in unions.items() if u != "all groups")
