"""Scalars, neighbourhoods, alignment, hunt, PCR and probe parts against brute force and known values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import dna, thermo
from strandline.operators import align, duplex, intervals, kmers, neighbors
from strandline.plans import hunt, padlock, search
from strandline.plans.config import HuntOptions, SearchOptions

Q, FLANK = "TCTCTGCACACACGTTGT", "GATTACAGGC"


def rc(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).head()[0]


def test_scalars(spark):
    assert one(spark, "acgtuRyN-", dna.revcomp) == "NNRYAACGT"
    assert one(spark, "GCNA", dna.gc_fraction) == -1 and one(spark, "", dna.gc_fraction) == -1 and one(spark, "GCAT", dna.gc_fraction) == 0.5
    assert one(spark, "acxT", dna.clean_dna) == "ACNT"
    assert one(spark, "AC--G--", dna.trailing_gap) == 2 and one(spark, "AC--G--", dna.nucleotide_length) == 3
    assert one(spark, "ACGT", dna.self_complementary) and not one(spark, "ACG", dna.self_complementary)
    assert one(spark, None, dna.revcomp) is None


@pytest.mark.parametrize(("oligo", "tm"), [("GCCCCATAGGTTTTGAACTCA", 58.1260), ("TGATTTGTCTGTAATTGCCAGC", 57.4939), ("TCTCTGCACACACGTTGT", 56.6716), ("TGCGTCTATTTAGTGGAGCC", 57.3300), ("AT" * 10, 31.7008), ("A" * 20, 41.4380), ("GC" * 10, 84.2606), ("CAG" * 7, 67.1621), ("ACGT" * 5, 60.4905)])
def test_tm_perfect(spark, oligo, tm):
    assert one(spark, oligo, thermo.tm_perfect) == pytest.approx(tm, abs=1e-4)


def test_neighborhood_is_minimal():
    random.seed(1)
    for n in (6, 9):
        q = "".join(random.choice("ACGT") for _ in range(n))
        got = neighbors.neighborhood(q, 1)
        assert all(not (a != b and a in b) for a in got for b in got)
        assert q not in got and q[1:] in got and q[:-1] in got
        assert len(neighbors.neighborhood(q, 1, indel=False)) == 1 + 3 * n
        assert len(neighbors.neighborhood(q, 2, cap=10)) <= 11


def edit_min(window: str, query: str) -> int:
    prev = [0] * (len(window) + 1)
    for i, c in enumerate(query, 1):
        row = [i]
        for j, w in enumerate(window, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != w)))
        prev = row
    return min(prev)


def test_align_is_optimal():
    random.seed(2)
    for _ in range(200):
        w, q = ("".join(random.choice("ACG") for _ in range(random.randint(3, 14))) for _ in range(2))
        score, start, a, b = align.align(w, q)
        assert -score == edit_min(w, q) and b.replace("-", "") == q and a.replace("-", "") == w[start : start + len(a.replace("-", ""))]


def hits(spark, chroms, o, q=Q):
    g = spark.createDataFrame(list(enumerate(chroms)), "chrom_id int, seq string")
    qs = spark.createDataFrame([(0, None, q)], "query_id int, name string, seq string")
    return sorted(tuple(r)[1:] for r in hunt.hunt(g, qs, o)[0].collect())


GOLD = [
    (FLANK + Q + FLANK, False, [(0, 0, 11, 28, "+", Q, Q)]),
    (Q + FLANK, False, [(0, 0, 1, 18, "+", Q, Q)]),
    ("G" + Q + FLANK, False, [(0, 0, 2, 19, "+", Q, Q)]),
    ("GA" + Q + FLANK, False, [(0, 0, 3, 20, "+", Q, Q)]),
    (FLANK + rc(Q) + FLANK, False, [(0, 0, 11, 28, "-", rc(Q), rc(Q))]),
    (FLANK + "TCTCTGCATACACGTTGT" + FLANK, False, [(1, 0, 11, 28, "+", "TCTCTGCATACACGTTGT", Q)]),
    (FLANK + Q[:10] + "G" + Q[10:] + FLANK, False, None),
    (FLANK + "TCTCTGCATACACGTTGT" + FLANK, True, [(1, 0, 11, 28, "+", "TCTCTGCATACACGTTGT", Q)]),
    (FLANK + Q + FLANK, True, [(0, 0, 11, 28, "+", Q, Q)]),
]


def test_hunt_known_cases(spark):
    for text, hamming, want in GOLD:
        got = hits(spark, [text], HuntOptions(hamming=hamming))
        if want is not None:
            assert got == want
        else:
            assert len(got) == 1 and got[0][0] == 1 and got[0][2:5] == (11, 29, "+")
    assert hits(spark, [FLANK, Q + FLANK], HuntOptions()) == [(0, 1, 1, 18, "+", Q, Q)]
    assert [h[2:4] for h in hits(spark, [Q + FLANK], HuntOptions(compat=True))] == [(1, 18), (2, 19)]
    pal = "ACGTTGCATGCAACGT"
    assert [h[4] for h in hits(spark, [FLANK + pal + FLANK], HuntOptions(), pal)] == ["+"]


def test_hunt_messages(spark):
    qs = spark.createDataFrame([(0, None, "ACGT"), (1, None, "ACGTXACGTACG")], "query_id int, name string, seq string")
    ready, said = hunt.prepare(qs, HuntOptions())
    assert [tuple(r) for r in ready.select("query_id", "seq").collect()] == [(1, "ACGTNACGTACG")]
    assert sorted((r["query_id"], r["type"]) for r in said.collect()) == [(0, "error"), (1, "warning")]


def test_hamming_brute_force_over_chunks(spark):
    random.seed(3)
    chroms = ["".join(random.choice("ACGTN" if k == 1 else "ACGT") for _ in range(random.randint(5, 400))) for k in range(5)]
    q = chroms[3][4:16] if len(chroms[3]) > 20 else "ACGTACGTACGT"
    want = set()
    for c, s in enumerate(chroms):
        for p in range(len(s) - len(q) + 1):
            for strand, x in (("+", q), ("-", rc(q))):
                w = s[p : p + len(q)]
                d = sum(a != b for a, b in zip(w, x))
                if d <= 2 and all(a == b or a in "ACGT" for a, b in zip(w, x)):
                    want.add((c, p, strand, d))
    g = spark.createDataFrame(list(enumerate(chroms)), "chrom_id int, seq string")
    qs = spark.createDataFrame([(0, q)], "query_id int, seq string")
    got = {(r["chrom_id"], r["pos"], r["strand"], r["distance"]) for r in hunt.hamming_hits(g, qs, 2).collect()}
    assert got == want
    n = kmers.windows(kmers.chunks(g, 6, core=16), 6).count()
    assert n == sum(max(0, len(s) - 5) for s in chroms)


def test_flatten_merges_touching(spark):
    rows = [(1, 0, 5), (1, 5, 8), (1, 10, 12), (1, 3, 4), (2, 1, 1)]
    got = intervals.flatten(spark.createDataFrame(rows, "c int, start long, end long"), ["c"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 8), (1, 10, 12)]


def test_amplicons_equal_nested_loop(spark):
    random.seed(4)
    sites = [(k, random.random() < 0.5, random.randint(0, 2), random.randint(0, 900), 20) for k in range(150)]
    got = {(r["for_primer_id"], r["rev_primer_id"]) for r in search.amplicons(spark.createDataFrame(sites, "primer_id int, on_forward boolean, chrom_id int, pos long, length int"), 120).collect()}
    want = {(a[0], b[0]) for a in sites for b in sites if a[1] and not b[1] and a[2] == b[2] and b[3] > a[3] and b[3] + 20 - a[3] <= 120}
    assert got == want


def test_spread_takes_from_the_left(spark):
    t = spark.createDataFrame([("a", k) for k in (0, 3, 39, 40, 60, 80)], "g string, k int")
    assert sorted(r["k"] for r in padlock.spread(t, ["g"], 40).collect()) == [0, 40, 80]


def test_duplex_program_equals_closed_form(spark):
    random.seed(6)
    oligos = ["".join(random.choice("ACGT") for _ in range(random.randint(12, 30))) for _ in range(40)] + ["AT" * 8, "GC" * 8, "CAG" * 6]
    df = spark.createDataFrame([(o, rc(o)) for o in oligos], "o string, r string")
    rows = duplex.site_tm(df, F.col("o"), F.col("r")).withColumn("want", thermo.tm_perfect(F.col("o"))).collect()
    assert all(r["tm"] == pytest.approx(r["want"], abs=1e-6) for r in rows)
    assert duplex.melt(["A" * 61, "", "AAAA"], ["T" * 61, "A", "CCCC"]) == [None, None, 0.0]
    one_site = duplex.melt([oligos[0]], [rc(oligos[0]) + "GG"])[0]
    assert one_site == pytest.approx(duplex.melt([oligos[0]], [rc(oligos[0])])[0], abs=1e-6)


def test_search_finds_a_product(spark):
    random.seed(7)
    seq = "".join(random.choice("ACGT") for _ in range(900))
    fwd, rev = seq[100:120], rc(seq[400:420])
    g = spark.createDataFrame([(0, seq)], "chrom_id int, seq string")
    p = spark.createDataFrame([(0, "f", fwd), (1, "r", rev), (2, "short", "ACGTACGTACGTACG")], "primer_id int, name string, seq string")
    sites, products, said = search.search(g, p, SearchOptions(cut_temp=30.0))
    assert [tuple(r)[:2] for r in said.collect()] == [(2, "warning")]
    assert {(r["primer_id"], r["on_forward"], r["pos"]) for r in sites.collect()} >= {(0, True, 100), (1, False, 400)}
    got = [r for r in products.collect() if r["for_pos"] == 100 and r["rev_pos"] == 400]
    assert len(got) == 1 and got[0]["seq"] == seq[100:420] and got[0]["product_length"] == 320
    assert got[0]["for_tm"] == pytest.approx(got[0]["for_match_tm"], abs=1e-6)


def test_repeated_primers_are_not_left_out(spark, tmp_path):
    """A primer with more sites than primer_prune lets pass binds at all of them, and each makes its product."""
    from strandline.queries import QUERIES

    random.seed(8)
    seq = "".join(random.choice("ACGT") for _ in range(400))
    spark.createDataFrame([(k, seq) for k in range(12)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for k in range(12):
        p = (k * 31) % 200
        want |= {(2 * k, True, c, p) for c in range(12)} | {(2 * k + 1, False, c, p + 150) for c in range(12)}
    sites = {(r["primer_id"], r["on_forward"], r["chrom_id"], r["pos"]) for r in QUERIES["primer_site_tm"](spark, str(tmp_path)).collect()}
    assert sites >= want
    pairs = {(f[2], f[0], r[0], f[3], r[3]) for f in sites for r in sites if f[1] and not r[1] and f[2] == r[2] and r[3] > f[3] and r[3] + 20 - f[3] <= 1000}
    got = QUERIES["insilico_pcr"](spark, str(tmp_path)).collect()
    assert {(r["chrom_id"], r["for_primer_id"], r["rev_primer_id"], r["for_pos"], r["rev_pos"]) for r in got} == pairs and len(got) == len(pairs)
    assert all(r["seq"] == seq[r["for_pos"] : r["rev_pos"] + 20] for r in got)


def test_operators_take_every_row_and_whole_sequences(spark, tmp_path):
    from strandline.queries import QUERIES

    random.seed(9)
    texts = ["".join(random.choice("ACGT") for _ in range(n)) for n in (18, 26, 60, 99, 100, 300, 17, 0)]
    spark.createDataFrame([(10 * k + k % 2, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = {10 * k + k % 2 for k in range(6)}
    got = {r["query_id"]: r for r in QUERIES["pairwise_align"](spark, str(tmp_path)).collect()}
    assert set(got) == ids and all(r["score"] == 0 and len(r["queryalign"]) == 18 for r in got.values())
    assert {r["query_id"] for r in QUERIES["edit_neighbors_minimal"](spark, str(tmp_path)).select("query_id").distinct().collect()} == ids
    hits = QUERIES["edit_hunt_align"](spark, str(tmp_path)).filter("distance = 0").collect()
    assert {r["query_id"] for r in hits} == {i for i in ids if i % 10 == 0}


def levenshtein(a: str, b: str) -> int:
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def test_edit_hunt_equals_brute_force(spark):
    random.seed(11)
    chroms = ["".join(random.choice("ACGT") for _ in range(random.randint(30, 200))) for _ in range(8)]
    queries = []
    for k in range(12):
        s = random.choice(chroms)
        at = random.randrange(len(s) - 14)
        q = list(s[at : at + 14])
        for _ in range(random.randint(0, 2)):
            i = random.randrange(len(q))
            q[i : i + 1] = random.choice([[], [random.choice("ACGT")], [q[i], random.choice("ACGT")]])
        q = "".join(q)
        queries.append((k, None, q if k % 2 else rc(q)))
    g = spark.createDataFrame(list(enumerate(chroms)), "chrom_id int, seq string")
    rows = hunt.hunt(g, spark.createDataFrame(queries, "query_id int, name string, seq string"), HuntOptions(max_matches=None))[0].collect()
    best = {}
    for r in rows:
        q = queries[r["query_id"]][2] if r["strand"] == "+" else rc(queries[r["query_id"]][2])
        ref = r["refalign"].replace("-", "")
        assert r["queryalign"].replace("-", "") == q and ref == chroms[r["chrom_id"]][r["start"] - 1 : r["end"]] and levenshtein(ref, q) == r["distance"] <= 1
        key = r["query_id"], r["chrom_id"]
        best[key] = min(best.get(key, 9), r["distance"])
    want = {}
    for k, _, q in queries:
        for c, s in enumerate(chroms):
            d = min(edit_min(s, q), edit_min(s, rc(q)))
            if d <= 1:
                want[k, c] = d
    assert best == want and want


def tm_of(o: str) -> float:
    import math

    h = thermo.INIT_H + sum(thermo.STACK[o[i : i + 2]][0] for i in range(len(o) - 1)) + sum(2200 for b in (o[0], o[-1]) if b in "AT")
    s = thermo.INIT_S + sum(thermo.STACK[o[i : i + 2]][1] for i in range(len(o) - 1)) + sum(6.9 for b in (o[0], o[-1]) if b in "AT")
    return h / (s + (len(o) - 1) * thermo.Ions().salt() + 1.9872 * math.log(50 / (1e9 if o == rc(o) else 4e9))) - 273.15


def test_padlock_edit_equals_brute_force(spark, tmp_path):
    """Whole probe design on a small genome: tiles of both strands, filters, both uniqueness tests, assembly and the greedy choice."""
    from strandline.queries import QUERIES

    random.seed(12)
    docs = {k: "".join(random.choice("ACGT") for _ in range(random.randint(260, 400))) for k in range(24)}
    docs[24] = docs[3][:200] + docs[4][100:260]  # what lies here twice is not unique
    codes = {k: "".join(random.choice("ACGT") for _ in range(20)) for k in range(60)}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(codes.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "|".join(docs.values())
    count = lambda w: sum(text.startswith(w, i) for i in range(len(text)))
    gc = lambda s: sum(b in "CG" for b in s) / len(s)
    genes = {f"G{c % 50}": k for k, c in enumerate(sorted(docs))}
    want = set()
    for c, seq in docs.items():
        n = len(seq)
        parts = sorted(((i * 37 + c * 13) % (n - 90), (i * 37 + c * 13) % (n - 90) + 20 + (i * 17 + c * 7) % 60) for i in range(4))
        flat = []
        for a, b in parts:
            if flat and a <= flat[-1][1]:
                flat[-1][1] = max(b, flat[-1][1])
            else:
                flat.append([a, b])
        for a, b in flat:
            exon = seq[a:b] if c % 2 == 0 else rc(seq[a:b])
            last = None
            for k in range(len(exon) - 39):
                x, y, probe = exon[k : k + 20], exon[k + 20 : k + 40], exon[k : k + 40]
                if not (0.4 <= gc(x) <= 0.6 and 0.4 <= gc(y) <= 0.6 and 0.4 <= gc(probe) <= 0.6):
                    continue
                if tm_of(x) > 93 + gc(x) - 675 / 20 or tm_of(y) > 93 + gc(y) - 675 / 20 or abs(tm_of(x) - tm_of(y)) > 2:
                    continue
                low = 81.5 + gc(probe) - 675 / 40
                if not low <= tm_of(probe) <= low + 10:
                    continue
                if any(count(z) + count(rc(z)) > 1 for z in (x, y)):
                    continue
                if any(sum(count(w) for s in (z, rc(z)) for w in neighbors.neighborhood(s, 1)) > 2 for z in (x, y)):
                    continue
                code = codes[genes[f"G{c % 50}"]]
                padlock_ = rc(x) + "TCCTC" + "TGCGTCTATTTAGTGGAGCC" + code + "TCTTT" + rc(y)
                if not 0.4 <= gc(padlock_) <= 0.6 or (last is not None and k < last + 40):
                    continue
                last = k
                want.add((f"G{c % 50}", c, a + k + 1 if c % 2 == 0 else b - k - 39, "+" if c % 2 == 0 else "-", probe, padlock_))
    got = {(r["gene_id"], r["chrom_id"], r["position"], r["strand"], r["probe"], r["padlock"]) for r in QUERIES["padlock_edit"](spark, str(tmp_path)).collect()}
    assert got == want and len({s for *_, s, _, _ in want}) == 2


def parameters(path, **given):
    """A directory of made-up tables: published stacks, and nothing else but what is given."""
    path.mkdir()
    inf = float("inf")
    put = lambda name, xs: (path / name).write_text("\n".join(str(x) for x in xs) + "\n")
    stack = {(a, b, "TGCA"["ACGT".index(a)], "TGCA"["ACGT".index(b)]): v for (a, b), v in thermo.STACK.items()}
    order = [(a, b, c, d) for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT"]
    for k, ext in enumerate(("dh", "ds")):
        put(f"stack.{ext}", [stack.get(x, (inf, inf))[k] for x in order])
        put(f"stackmm.{ext}", [given.get("mismatch", (inf, inf))[k]] * 256)
        put(f"tstack2.{ext}", [given.get("outer", (inf, inf))[k]] * 256)
        put(f"dangle.{ext}", [given.get("dangle3", (inf, inf))[k]] * 64 + [given.get("dangle5", (inf, inf))[k]] * 64)
        put(f"loops.{ext}", [f"{n} {given.get('interior', (inf, inf))[k]} {given.get('bulge', (inf, inf))[k]} inf" for n in range(1, 31)])
        put({"dh": "tstack.dh", "ds": "tstack_tm_inf.ds"}[ext], [given.get("inner", (inf, inf))[k]] * 256)
    return str(path)


def test_duplex_with_parameter_tables(tmp_path):
    """Terminal mismatches, dangling ends, bulges and interior loops against sums made by hand."""
    import math

    import pytest

    from strandline.functions.thermo import STACK, Ions

    o = "GATCCAGTCAGGTACTGCAC"
    salt, conc = Ions().salt(), 1.9872 * math.log(50 / 4e9)
    end = lambda b: (2200.0, 6.9) if b in "AT" else (0.0, 1e-11)

    def tm(h, s, pairs):
        return h / (s + (pairs - 1) * salt + conc) - 273.15

    def stacks(x):
        return sum(STACK[x[i : i + 2]][0] for i in range(len(x) - 1)), sum(STACK[x[i : i + 2]][1] for i in range(len(x) - 1))

    bare = parameters(tmp_path / "bare")
    assert duplex.melt([o], [rc(o) + "AA"], directory=bare)[0] == pytest.approx(duplex.melt([o], [rc(o)])[0])
    # One base beyond the second oligo's 3' end, next to o's beginning, dangles.
    d3 = parameters(tmp_path / "d3", dangle3=(-3000.0, -8.0))
    h, s = stacks(o)
    want = tm(h + 200 + end(o[-1])[0] + end(o[0])[0] - 3000, s - 5.7 + end(o[-1])[1] + end(o[0])[1] - 8.0, 20)
    assert duplex.melt([o], [rc(o) + "G"], directory=d3)[0] == pytest.approx(want, abs=1e-6)
    # A base of o in the middle meets one that it can't pair with.
    mm = parameters(tmp_path / "mm", mismatch=(-1500.0, -3.0))
    other = o[:10] + {"A": "C", "C": "A", "G": "T", "T": "G"}[o[10]] + o[11:]
    (h1, s1), (h2, s2) = stacks(o[:10]), stacks(o[11:])
    want = tm(h1 + h2 - 3000 + 200 + end(o[0])[0] + end(o[-1])[0], s1 + s2 - 6 - 5.7 + end(o[0])[1] + end(o[-1])[1], 19)
    assert duplex.melt([o], [rc(other)], directory=mm)[0] == pytest.approx(want, abs=1e-6)
    # A base of o that has none opposite: a bulge of one, with the stack of its neighbours.
    bu = parameters(tmp_path / "bu", bulge=(500.0, -2.0))
    (h1, s1), (h2, s2), (hb, sb) = stacks(o[:10]), stacks(o[11:]), STACK[o[9] + o[11]]
    want = tm(h1 + h2 + hb + 500 + 200 + end(o[0])[0] + end(o[-1])[0], s1 + s2 + sb - 2 - 5.7 + end(o[0])[1] + end(o[-1])[1], 19)
    assert duplex.melt([o], [rc(o[:10] + o[11:])], directory=bu)[0] == pytest.approx(want, abs=1e-6)
    # Two bases that have none opposite: the longer bulge counts the ends of both helices.
    (h1, s1), (h2, s2) = stacks(o[:10]), stacks(o[12:])
    inner = [end(o[9]), end(o[12])]
    want = tm(h1 + h2 + 500 + sum(x for x, _ in inner) + 200 + end(o[0])[0] + end(o[-1])[0], s1 + s2 - 2 + sum(y for _, y in inner) - 5.7 + end(o[0])[1] + end(o[-1])[1], 18)
    assert duplex.melt([o], [rc(o[:10] + o[12:])], directory=bu)[0] == pytest.approx(want, abs=1e-6)
    # Two bases opposite one: an interior loop with an asymmetry of one.
    il = parameters(tmp_path / "il", interior=(1000.0, -1.0), inner=(-800.0, -2.0))
    twist = {"A": "C", "C": "A", "G": "T", "T": "G"}
    (h1, s1), (h2, s2) = stacks(o[:10]), stacks(o[12:])
    want = tm(h1 + h2 + 1000 - 1600 + 200 + end(o[0])[0] + end(o[-1])[0], s1 + s2 - 1 - 4 - 300 / 310.15 - 5.7 + end(o[0])[1] + end(o[-1])[1], 18)
    got = max(duplex.melt([o], [rc(o[:10] + b + o[12:])], directory=il)[0] for b in {twist[o[10]], twist[o[11]]})
    assert got == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError, match="lacks"):
        duplex.load(str(tmp_path))


def test_oligos_that_no_program_can_melt_are_an_error(spark):
    df = spark.createDataFrame([("A" * 61, "T" * 61)], "o string, r string")
    with pytest.raises(Exception, match="No melting temperature"):
        duplex.site_tm(df, F.col("o"), F.col("r")).collect()


def test_substitutions_of_long_texts(spark):
    random.seed(13)
    rows = []
    for n in (1, 14, 15, 16, 31, 47):
        a = "".join(random.choice("ACGT") for _ in range(n))
        b = "".join(random.choice("ACGTN") if random.random() < 0.3 else x for x in a)
        rows.append((a, b, sum(x != y for x, y in zip(a, b))))
    got = spark.createDataFrame(rows, "a string, b string, n int").withColumn("d", dna.substitutions(F.col("a"), F.col("b"), 47)).collect()
    assert all(r["d"] == r["n"] for r in got)


def test_slim_join_and_index_find_the_same(spark, monkeypatch):
    random.seed(14)
    chroms = ["".join(random.choice("ACGT") for _ in range(900)) for _ in range(3)]
    g = spark.createDataFrame(list(enumerate(chroms)), "chrom_id int, seq string")
    qs = spark.createDataFrame([(k, None, chroms[k % 3][40 * k : 40 * k + 18]) for k in range(12)], "query_id int, name string, seq string")
    run = lambda o, index=None: sorted(tuple(r) for r in hunt.hunt(g, qs, o, index)[0].collect())
    for o in (HuntOptions(hamming=True), HuntOptions()):
        plain = run(o)
        assert plain and run(o, kmers.kmers(g, 7)) == plain and run(o, kmers.kmers(g, 40)) == plain
        with monkeypatch.context() as m:
            m.setattr(kmers, "BROADCAST_PATTERNS", 0)
            assert run(o) == plain


def test_gene_codes(spark):
    import itertools

    from strandline.operators import codes

    every = ["".join(x) for x in itertools.product("1234", repeat=6)]
    assert sorted(x["code"] for x in codes.words(spark, "1234", 6).collect()) == every
    assert [x["code"] for x in codes.words(spark, "ab", 0).collect()] == [""]
    got = {x["code"]: x["weight"] for x in codes.eligible(codes.words(spark, "1234", 6)).collect()}
    assert got == {c: (101, 52, 3)[c.count("1")] for c in every if len(set(c)) >= 3 and c.count("1") <= 2}
    taken = codes.choose(spark)
    assert len(set(taken)) == 500 and set(taken) <= set(got) and taken == codes.choose(spark) != codes.choose(spark, seed=2)
    assert all(sum(a != b for a, b in zip(x, y, strict=True)) >= 2 for x, y in itertools.combinations(taken, 2))


def test_best_score_equals_recursion(spark):
    import functools
    import random

    from strandline.operators import align

    def slow(a, b, s, fa, fb):
        @functools.cache
        def at(i, j):
            ways = [0] if i == j == 0 else []
            if i and j:
                ways.append(at(i - 1, j - 1) + (s.match if a[i - 1] == b[j - 1] else s.mismatch))
            if i:
                ways.append(at(i - 1, j) + (0 if fa and j in (0, len(b)) else s.gap))
            if j:
                ways.append(at(i, j - 1) + (0 if fb and i in (0, len(a)) else s.gap))
            return max(ways)

        return at(len(a), len(b))

    r = random.Random(4)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(r.randint(0, n)))
    for s in (align.Scores(), align.Scores(0, -1, -1), align.Scores(2, -3, -4)):
        for _ in range(60):
            a, b, fa, fb = dna(12), dna(9), r.random() < 0.5, r.random() < 0.5
            assert align.best_score(a, b, s, fa, fb) == slow(a, b, s, fa, fb)
    a, b = "ACGTACGGTCA", "CGTTACG"
    assert align.best_score(a, b, align.Scores(0, -1, -1), free_a=True) == align.align(a, b)[0]
    df = spark.createDataFrame([(a, b), (None, b), ("", "")], "a string, b string")
    assert [x["best_score"] for x in align.score_column(df, "a", "b").collect()] == [align.best_score(a, b), None, 0]
