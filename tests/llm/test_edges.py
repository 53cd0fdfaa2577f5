"""Nulls, empty and long texts, repeated rows, empty tables and extra columns with clashing names, for every operator and stage."""

from __future__ import annotations

import random

import pytest

P = pytest.importorskip("public_tokenizers")
bpe, decontaminate, fingerprint, html_blocks, langid, lm, minhash_dedup, token_counts, toxicity, warc_fixity = (
    pytest.importorskip(f"strandline.llm.{m}") for m in ("bpe", "decontaminate", "fingerprint", "html_blocks", "langid", "lm", "minhash_dedup", "token_counts", "toxicity", "warc_fixity")
)
corpus_pipeline = pytest.importorskip("corpus_pipeline")

#: Extra columns that bear the names of results and of intermediate columns.
EXTRA = ["h", "c", "row", "node", "id", "copies", "key", "band", "bucket", "digest", "k", "n", "m", "score", "held_out", "predicted", "lang_pred", "n_tokens", "n_known", "base_score", "n_shingles", "component_id", "kept", "fingerprint", "n_chars", "n_bytes", "over_limit", "toxic", "sketch", "bands", "item_id", "slot", "offset", "length", "status", "hash", "x", "u", "v", "root", "__text", "__0", "__parts", "__salt", "a.b", "a`b"]
HEAD = "doc_id long, text string, lang string, source string"
SCHEMA = HEAD + "".join(f", `{c.replace('`', '``')}` string" for c in EXTRA)
r = random.Random(31)
WORDS = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG, TWIN = prose(60_000), prose(50)
TEXTS = [(k, prose(40), "en", "s") for k in range(30)] + [
    (30, None, "en", "s"),
    (31, "", None, "s"),
    (32, " \t\n ", "en", None),
    (33, LONG, "en", "s"),
    (34, TWIN, "en", "s"),
    (34, TWIN, "en", "s"),
    (35, TWIN, "en", "s"),
    (36, "日本語" * 200 + "\u0000é", "en", "s"),
    (37, "123 456", None, "s"),
    (None, TWIN, "en", "s"),
    (None, None, None, None),
]
N = len(TEXTS)


def documents(spark, rows):
    return spark.createDataFrame([(*x, *(["odd"] * len(EXTRA))) for x in rows], SCHEMA)


def labels(spark, rows=((1, 0), (2, 1), (2, 0), (None, 1), (3, None), (34, 0))):
    return spark.createDataFrame([(a, b, "odd", "odd", "odd") for a, b in rows], "doc_id long, toxic int, text string, score string, `a.b` string")


def bench(spark, rows=((0, "nothing of the kind"), (None, TWIN), (1, None), (2, ""), (2, ""))):
    return spark.createDataFrame([(a, b, "odd", "odd", "odd") for a, b in rows], "item_id long, text string, doc_id string, h string, `a.b` string")


def pages(spark, rows):
    return spark.createDataFrame([(*x, "odd", "odd", "odd", "odd", "odd", "odd") for x in rows], "page_id long, url string, html string, text string, n_chars string, offset string, hash string, segment string, `a.b` string")


def operators(spark, docs):
    return {
        "toxicity": lambda: toxicity.toxicity(docs, labels(spark)),
        "langid": lambda: langid.identify(docs),
        "bpe": lambda: bpe.encode_decode(docs, P.path("word_bpe_49k.json")),
        "lm": lambda: lm.score(docs),
        "near": lambda: minhash_dedup.near_duplicates(docs, k=3, percent=85),
        "counts": lambda: token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "fingerprint": lambda: fingerprint.fingerprints(docs),
    }


NAMES = ["toxicity", "langid", "bpe", "lm", "near", "counts", "fingerprint"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_every_row(spark, name):
    got = operators(spark, documents(spark, TEXTS))[name]().collect()
    assert len(got) == N
    assert sorted(str(x["doc_id"]) for x in got) == sorted(str(x[0]) for x in TEXTS)
    twins = [x.asDict() for x in got if x["doc_id"] == 34]
    if name != "fingerprint":  # there, the text beside a repeated one may differ
        assert twins[0] == twins[1]
    by = {x["doc_id"]: x for x in got if x["doc_id"] is not None}
    if name == "toxicity":
        assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    if name == "langid":
        assert [by[k]["lang_pred"] for k in (30, 31, 32, 37)] == ["und"] * 4 and all(0 <= x["score"] <= 1 for x in got)
    if name == "lm":
        assert [by[k]["n_tokens"] for k in (30, 31, 32, 37)] == [1, 1, 1, 3] and all(x["score"] < 0 for x in got)
    if name == "near":
        assert [by[k]["component_id"] for k in (30, 31, 34, 35)] == [30, 31, 34, 34] and [by[k]["n_shingles"] for k in (30, 31, 32, 37)] == [0, 0, 0, 1]
    if name in ("bpe", "counts"):
        assert by[30]["n_tokens"] == by[31]["n_tokens"] == 0 and by[33]["n_tokens"] > 60_000
    if name == "fingerprint":
        same = {x["fingerprint"] for x in got if x["doc_id"] in (34, 35)}
        assert len(same) == 1 and by[33]["n_chars"] == len(LONG) and by[30]["n_chars"] == 0


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark, documents(spark, []))[name]().collect() == []


def test_decontamination_of_odd_rows(spark):
    docs = documents(spark, TEXTS)
    got = decontaminate.contaminated(docs, bench(spark)).collect()
    assert {x["doc_id"] for x in got} <= {x[0] for x in TEXTS}
    assert decontaminate.contaminated(documents(spark, []), bench(spark)).count() == 0
    assert decontaminate.contaminated(docs, bench(spark, [(5, TWIN)])).filter("doc_id in (34, 35)").select("doc_id").distinct().count() == 2
    assert decontaminate.keep_uncontaminated(docs, bench(spark, [])).count() == N
    assert decontaminate.keep_uncontaminated(documents(spark, []), bench(spark)).count() == 0


def test_html_of_odd_rows(spark):
    para = "".join(f"<p>{prose(30)}.</p>" for _ in range(5))
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{para}</article></body></html>"
    deep = "<div>" * 20_000 + para
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (4, "u", deep), (5, "u", page.replace(para, para * 300))]
    got = html_blocks.extract(pages(spark, rows)).collect()
    by = {x["page_id"]: x for x in got}
    assert len(got) == len(rows) and by[2]["text"] == by[3]["text"] == "" and by[2]["n_chars"] == 0
    assert all(x["n_chars"] == len(x["text"]) for x in got) and len({x["text"] for x in got if x["page_id"] in (1, None)}) == 1
    assert by[5]["n_chars"] > 200 * by[1]["n_chars"]
    assert html_blocks.extract(pages(spark, [])).count() == 0


def test_fixity_of_odd_rows(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, None, None), (3, "u", ""), (None, "u", "x"), (10**12, "u", LONG)]
    a = pages(spark, rows)
    assert {x["page_id"]: x["status"] for x in warc_fixity.fixity(a, a).collect()} == {1: "ok", 2: "ok", 3: "ok", 10**12: "ok"}
    assert {x["status"] for x in warc_fixity.fixity(a, pages(spark, [])).collect()} == {"missing"}
    assert warc_fixity.fixity(pages(spark, []), pages(spark, [])).count() == 0


def test_stages_keep_odd_columns(spark, tmp_path):
    docs = documents(spark, TEXTS)
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark, [(0, prose(20)), (None, None)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = set(range(30)) | {33, 34}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "bpe" or out.columns == docs.columns
        ids = [x["doc_id"] for x in out.select("doc_id").collect()]
        assert clean <= set(ids) and len(ids) <= N, name
        assert stage(spark, documents(spark, []), str(tmp_path)).count() == 0, name
        if name == "near_dedup":
            assert ids.count(34) == 2 and 35 not in ids  # rows that repeat an id are one document, and stay together


def test_pipeline_of_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark, []).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
