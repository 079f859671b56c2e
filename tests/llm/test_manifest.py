"""The Merkle manifest against a plain recursive one."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sluice.llm import manifest
from sluice.llm.queries import op13_merkle_manifest, ready

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, _tree string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, text):
    return h("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def tree(digests):
    """The root, and for each leaf its siblings, as (before, after) for each level."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 3 * 3:a // 3 * 3 + 3]
            paths[i].append(("".join(run[:a % 3]), "".join(run[a % 3 + 1:])))
        level = [h("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
        at = [a // 3 for a in at]
    return level[0], paths


def expected(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own, subroots = {}, []
    for s in sources:
        members = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        root, paths = tree([leaf_of(r, r["text"]) for r in members])
        subroots.append(root)
        own[s] = (members, paths)
    root, tops = tree(subroots)
    out = []
    for s, subroot, top in zip(sources, subroots, tops):
        for r, path in zip(*own[s]):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            cur, proof = leaf_of(r, text), ""
            for before, after in path + top:
                cur, proof = h(before + cur + after), proof + before + after
            out.append((r["doc_id"], leaf_of(r, r["text"]), subroot, root, h(proof), cur, cur == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def tampered(df, levels=manifest.LEVELS):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest.manifest(df, {"text": text}, levels=levels)


ODD = [
    (1, "a\nb", "en", "s", 3, "x", "y"), (2, "a\nb", "en", "s", 3, "x", "y"), (2, "a\nb", "en", "s", 3, "x", "y"), (None, None, None, None, None, None, None),
    (3, "", None, None, 0, None, None), (4, "é\n" * 5000, "fr", "", 10000, None, None), (-5, "z", "en", "é", 1, None, None), (6, "\n", "en", "n", 1, None, None)]


@pytest.mark.parametrize(("more", "levels"), [(0, 6), (1, 6), (30, 1), (30, 2)])
def test_manifest_agrees_with_recursion(spark, more, levels):
    ready(spark)
    rows = ODD + [(10 + i, f"t{i}\n", "en", "hot" if i % 3 else f"s{i}", i, None, None) for i in range(more)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(tampered(df, levels)) == expected([dict(zip(df.columns, r)) for r in rows])


def test_rounds_of_blocks(spark):
    nodes = spark.range(20).selectExpr("'t' AS _tree", "id AS _index", "20L AS _size", "cast(id AS string) AS _digest")
    assert [r.count() for r in manifest.raised(nodes, "t", 1)] == [20, 7, 3, 1]


def test_a_single_row_and_no_row(spark):
    ready(spark)
    one = spark.createDataFrame(ODD[:1], SCHEMA)
    (row,) = tampered(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h("")
    nothing = tampered(spark.createDataFrame([], SCHEMA))
    assert nothing.count() == 0 and nothing.columns == tampered(one).columns


def test_whole_table(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(op13_merkle_manifest(spark, sf_dir)) == expected(rows)


def test_sweeps_need_no_recursion():
    digests = [h(str(i)) for i in range(100)]
    top, received = manifest.swept_up(0, digests, 5)
    paths = manifest.swept_down(received, (5, 0), [])
    assert {manifest.folded(d, paths[i]) for i, d in enumerate(digests)} == {top} == {tree(digests)[0]}
