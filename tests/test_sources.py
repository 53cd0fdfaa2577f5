from __future__ import annotations

import gzip
import json

import pytest

from strandline import sinks
from strandline.plans.config import HuntOptions
from strandline.plans.hunt import hunt
from strandline.sources import fasta, gtf, tables


def test_fasta_gtf_and_lists(spark, tmp_path):
    g = tmp_path / "g.fa.gz"
    g.write_bytes(gzip.compress(b">c1 first\nacgt\r\nAC\n>c2\n\nGG\n>empty\n"))
    assert [(r["chrom"], r["seq"]) for r in fasta.read_genome(spark, str(g)).orderBy("chrom_id").collect()] == [("c1", "ACGTAC"), ("c2", "GG")]
    b = tmp_path / "b.fa"
    b.write_text(">x\nacg\n\n>y\nttt\n")
    assert [tuple(r) for r in fasta.read_barcodes(spark, str(b)).orderBy("ordinal").select("code", "barcode").collect()] == [("x", "ACG"), ("y", "TTT")]
    t = tmp_path / "a.gtf"
    t.write_text('#c\nc1\ts\texon\t1\t4\t.\t-\t.\tgene_id "G1"; gene_name "N 1"; transcript_biotype "protein_coding";\nc1\ts\tCDS\t1\t2\t.\t+\t.\tgene_id "G1";\nc9\ts\texon\t1\t2\t.\t+\t.\tgene_id "G2";\n')
    e = gtf.exons(gtf.read_gtf(spark, str(t)), fasta.read_genome(spark, str(g)), protein_coding=True)
    assert [(r["gene_id"], r["symbol"], r["start"], r["end"], r["strand"]) for r in e.collect()] == [("G1", "N", 0, 4, "-")]
    (tmp_path / "l").write_text("A1,x\nB2 y\n\n")
    assert sorted(r[0] for r in tables.read_gene_list(spark, str(tmp_path / "l")).collect()) == ["A1", "B2"]
    (tmp_path / "bed").write_text("c1\t2\t5\n#x\n")
    assert [tuple(r) for r in tables.read_bed(spark, str(tmp_path / "bed")).collect()] == [("c1", 2, 5)]


def test_hunt_document(spark):
    g = spark.createDataFrame([(0, "c1", "GATTACAGGCTCTCTGCACACACGTTGTGATTACA")], "chrom_id int, chrom string, seq string")
    q = spark.createDataFrame([(0, None, "TCTCTGCACACACGTTGT"), (1, None, "ACG")], "query_id int, name string, seq string")
    o = HuntOptions()
    hits, said = hunt(g, q, o)
    docs = sinks.hunt_documents(q, hits, said, g, o, {"version": "0"})
    got = {r["query_id"]: json.loads(r["value"]) for r in docs.collect()}
    assert [d["start"] for d in got[0]["data"]] == [11] and "data" not in got[1] and got[1]["errors"][0]["type"] == "error"
    assert sinks.hunt_text(docs).head()[0].startswith(">c1:11-28 (Strand: +, Distance: 0)")


def test_entry_point_without_llm(monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("strandline.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "strandline.llm", None)
    e = importlib.import_module("__spark_entry__")
    assert "hamming_hunt_d1" in e.queries() and not any(n.startswith("op") for n in e.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_fasta_headers_may_hold_the_mark(spark, tmp_path):
    g = tmp_path / "g.fa"
    g.write_text(">chr1 a>b c\nAC\nGT\n>chr2\nTT>A\n")
    assert [(r["name"], r["seq"]) for r in fasta.read_fasta(spark, str(g)).orderBy("record").collect()] == [("chr1 a>b c", "ACGT"), ("chr2", "TT>A")]


def test_commands(spark, tmp_path, capsys):
    """index, hunt, search and padlock from files to files."""
    import random

    from strandline import cli
    from strandline.operators import kmers

    random.seed(3)
    seq = "".join(random.choice("ACGT") for _ in range(3000))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    (tmp_path / "GRCh38.fa.gz").write_bytes(gzip.compress(f">chr1 x\n{seq[:1500]}\n{seq[1500:]}\n>chr2\n{'ACGT' * 50}\n".encode()))
    (tmp_path / "plain.fa").write_text(">a\nACGT\n")
    genome = str(tmp_path / "GRCh38.fa.gz")
    assert cli.main([]) == 1 and cli.main(["index", str(tmp_path / "plain.fa")]) == 1 and cli.main(["hunt", "-g", "/none", "-o", "x", "ACGT"]) == 1
    assert cli.main(["index", genome, "-k", "8", "--name", "kmers_of_test"]) == 0
    q = seq[100:118]
    (tmp_path / "q.fa").write_text(f">one\n{q}\n>two\nACG\n>three\n{rc(q)}\n")
    found = {}
    for name, more in (("plain", []), ("by_index", ["--index", "kmers_of_test"]), ("hamming", ["-n"])):
        assert cli.main(["hunt", "-g", genome, "-o", str(tmp_path / name), *more, str(tmp_path / "q.fa")]) == 0
        docs = spark.read.text(str(tmp_path / name))
        found[name] = sorted((r["name"], r["chr"], r["start"], r["strand"], r["distance"]) for r in sinks.hunt_rows(docs).collect())
    assert found["plain"] == found["by_index"] and ("one", "chr1", 101, "+", 0) in found["hamming"] and ("three", "chr1", 101, "-", 0) in found["plain"]
    capped = spark.createDataFrame([(0, None, "ACGTACGTACGT")], "query_id long, name string, seq string")
    said = hunt(fasta.read_genome(spark, genome), capped, HuntOptions(max_matches=5, max_neighborhood=20))[1].collect()
    assert sorted(r["title"].split()[1] for r in said) == ["5", "The"]  # both caps are told

    (tmp_path / "p.fa").write_text(f">f\n{seq[200:221]}\n>r\n{rc(seq[500:521])}\n>short\nACGTACGTACGT\n>withn\n{seq[700:721]}N{seq[722:728]}\n")
    assert cli.main(["search", "-g", genome, "-o", str(tmp_path / "s"), "-c", "30", str(tmp_path / "p.fa")]) == 0
    lines = spark.read.text(str(tmp_path / "s"))
    whole = json.loads("".join(gzip.decompress(x.read_bytes()).decode() for x in sorted((tmp_path / "s").glob("part-*"))))
    assert [m["type"] for m in whole["errors"]] == ["warning", "warning"] and whole["meta"]["subcommand"] == "search"
    primers, amplicons = whole["data"]["primers"], whole["data"]["amplicons"]
    assert [x["Id"] for x in primers] == list(range(len(primers))) and [x["Tm"] for x in primers] == sorted((x["Tm"] for x in primers), reverse=True)
    assert amplicons[0]["Length"] == 321 and amplicons[0]["Seq"] == seq[200:521] and amplicons[0]["ForPos"] == 201 and list(amplicons[0]) == list(sinks.AMPLICON_KEYS)
    from strandline.operators import duplex

    withn = seq[700:721] + "N" + seq[722:728]
    assert [x["MatchTm"] for x in primers if x["Name"] == "withn"] == [pytest.approx(duplex.melt([withn], [rc(withn)])[0])]
    for given in (lines, spark.createDataFrame([(json.dumps(whole, separators=(",", ":")),)], "value string")):
        a, b = sinks.search_rows(given)
        assert sorted(x["Id"] for x in a.collect()) == [x["Id"] for x in primers] and b.count() == len(amplicons)
    text = sinks.search_text(a, b).orderBy("Id").collect()
    assert any("Amplicon_0_ForPos=chr1:201-221" in x["value"] for x in text)
    assert sinks.search_tsv(b).head()[0].split("\t")[:3] == ["Amplicon", "0", "321"] and sinks.search_tsv(a).head()[0].startswith("Primer\t")

    rows = [("chr1", 1, 800, "+", "G1"), ("chr1", 1001, 1900, "-", "G2"), ("chr2", 1, 100, "+", "G3")]
    (tmp_path / "a.gtf").write_text("".join(f'{c}\ts\texon\t{x}\t{y}\t.\t{s}\t.\tgene_id "{g}"; gene_name "N{g}";\n' for c, x, y, s, g in rows))
    (tmp_path / "b.fa").write_text(">c1\nACGTACGTTGCAACGTAGCA\n>c2\nTGCATGCAAGCTTGCATGCA\n")
    args = ["padlock", "-g", genome, "-t", str(tmp_path / "a.gtf"), "-b", str(tmp_path / "b.fa"), "-o", str(tmp_path / "out.tsv"), "-j", str(tmp_path / "out.json")]
    assert cli.main([*args, "all"]) == 0 and "1 genes have no barcode" in capsys.readouterr().err
    out = [x.split("\t") for f in sorted((tmp_path / "out.tsv").glob("part-*")) for x in f.read_text().splitlines()]
    assert out[0] == list(sinks.PADLOCK_COLUMNS) and len(out) > 3 and {x[0] for x in out[1:]} == {"G1", "G2"}
    for x in out[1:]:
        at = int(x[3].split(":")[1])
        probe = seq[at - 1 : at + 39]
        assert x[7] == (probe if x[5] == "+" else rc(probe))[:20] + "-" + (probe if x[5] == "+" else rc(probe))[20:]
        assert x[12] == rc(x[7][:20]) + "TCCTC" + "TGCGTCTATTTAGTGGAGCC" + x[10] + "TCTTT" + rc(x[7][21:]) and x[4].startswith("https://genome.ucsc.edu/cgi-bin/hgTracks?db=hg38&position=chr1:")
    doc = json.loads("".join(gzip.decompress(x.read_bytes()).decode() for x in sorted((tmp_path / "out.json").glob("part-*"))))
    assert doc["data"]["columns"] == out[0] and doc["data"]["rows"] == out[1:]
    assert cli.main([*args, "G9"]) == 1
    (tmp_path / "targets.fa").write_text(f">t1\n{''.join(random.choice('ACGT') for _ in range(500))}\n")
    assert cli.main([*args, "-e", str(tmp_path / "targets.fa")]) == 0
    got = [x for f in sorted((tmp_path / "out.tsv").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(got) > 1 and got[1].split("\t")[4] == "n.a."
    spark.sql("drop table kmers_of_test")
    assert kmers.index_width(spark.createDataFrame([], "kmer string, chrom_id int, pos long")) == 0
