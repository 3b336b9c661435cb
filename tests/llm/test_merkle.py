import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import merkle_manifest
from sparkloom.llm.queries import QUERIES

A_Z = {c: c + 32 for c in range(65, 91)}


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes, fanout=8):
    """All levels of a tree by plain loops."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, i, fanout=8):
    out = []
    for level in levels[:-1]:
        begin = i - i % fanout
        run = level[begin : begin + fanout]
        out.append((run[: i - begin], run[i - begin + 1 :]))
        i //= fanout
    return out


def brute(docs, fanout=8):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    by = defaultdict(list)
    for d in docs:
        by[d[2]].append((d[0] is not None, d[0] or 0, H(*map(enc, d)), d))
    langs = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([r[2] for r in sorted(by[x], key=lambda r: r[:3])], fanout) for x in langs]
    top = climb([t[-1][0] for t in trees], fanout)
    out = []
    for k, lang in enumerate(langs):
        for i, (_, _, leaf, d) in enumerate(sorted(by[lang], key=lambda r: r[:3])):
            path = siblings(trees[k], i, fanout) + siblings(top, k, fanout)
            changed = d[4] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
            node = H(*map(enc, (*d[:4], d[4].translate(A_Z)))) if changed else leaf
            for left, right in path:
                node = H(*left, node, *right)
            proof = H(*[x for left, right in path for x in (*left, *right)])
            out.append((d[0], leaf, trees[k][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return Counter(out)


def query_rows(df):
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return Counter(tuple(r) for r in df.select(*names).collect())


def test_query_equals_brute_force(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select(*merkle_manifest.FIELDS).collect()]
    assert query_rows(QUERIES["op12_merkle_manifest"](spark, data)) == brute(docs)


def written(spark, tmp_path, docs):
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_edge_rows_through_the_query(spark, tmp_path, edge_rows):
    docs = [(r[0], r[3], r[2], r[4], r[1]) for r in edge_rows]
    assert query_rows(QUERIES["op12_merkle_manifest"](spark, written(spark, tmp_path, docs))) == brute(docs)


def test_empty_table(spark, tmp_path):
    assert QUERIES["op12_merkle_manifest"](spark, written(spark, tmp_path, [])).collect() == []


@pytest.mark.parametrize(("sizes", "fanout", "levels"), [((1,), 2, 1), ((7, 8, 9), 3, 2), ((64, 65, 1, 3), 2, 3), ((1,) * 9, 2, 2)])
def test_superblocks_meet_like_plain_levels(spark, sizes, fanout, levels):
    """Trees of uneven heights whose blocks end within a level's runs."""
    docs = [(k, "s", f"lang{j}", k, f"Text {k}") for j, n in enumerate(sizes) for k in range(100 * j, 100 * j + n)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle_manifest.manifest(df, fanout=fanout, levels=levels)
    proof = F.sha2(merkle_manifest.hexed("proof"), 256).alias("sha")
    rows = found.select("*", *[merkle_manifest.hexed(c).alias(f"{c}_hex") for c in ("leaf", "subroot", "root")], proof).collect()
    assert Counter((r["key"], r["leaf_hex"], r["subroot_hex"], r["root_hex"], r["sha"]) for r in rows) == Counter({k[:5]: n for k, n in brute(docs, fanout).items()})
    for r in rows:
        assert merkle_manifest.fold(bytes(r["leaf"]), bytes(r["proof"]), r["places"], r["runs"]) == bytes(r["root"])


def test_clashing_columns(spark, clashing, edge_docs):
    same = [sorted(merkle_manifest.manifest(d).select(merkle_manifest.hexed("root")).distinct().collect()) for d in (clashing, edge_docs)]
    assert same[0] == same[1] and len(same[0]) == 1


def test_a_changed_sibling_breaks_the_proof(spark):
    df = spark.createDataFrame([(k, "s", "en", 1, f"t{k}") for k in range(20)], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle_manifest.manifest(df).first()
    proof = bytearray(r["proof"])
    proof[5] ^= 1
    assert merkle_manifest.fold(bytes(r["leaf"]), bytes(proof), r["places"], r["runs"]) != bytes(r["root"])
