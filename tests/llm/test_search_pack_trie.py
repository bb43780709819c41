"""Hard negatives, packing and the prefix trie against brute force, and on odd rows."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilwork.errors import InputError
from veilwork.llm import hard_negatives, packing, prefix_trie, token_blocks
from veilwork.llm.common import table, written
from veilwork.llm.queries import model_bytes

WORDS = model_bytes(public_tokenizers.path("word_bpe_49k.json")).decode()
#: Extra columns with the names that operators use inside.
CLASH = ["a", "w", "h", "rid", "dim", "q", "cell", "need", "score", "bits", "phase", "base", "part", "first", "size", "ids", "conv", "p", "key", "bytes", "name", "depth", "node", "at", "n", "square"]


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASH})


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, found = entry.queries()[name](spark, sf), c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    a = [tuple(r[x] for x in order) for r in df.collect()]
    b = [tuple(r[names.index(x)] for x in order) for r in found.fetchall()]
    assert len(a) and sorted(a, key=str) == sorted(b, key=str)


# --- 11 ---------------------------------------------------------------------------------------------------------------


def mined(rows, every=50, positives=5, negatives=3, scale=256):
    """Brute force over rows that take part, repeated rows being rows of their own."""
    live = [(i, lab, [int(np.floor(scale * float(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (a, lab, q) in enumerate(live):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r, strict=True)), i, n, other) for n, (i, other, r) in enumerate(live) if n != k and len(r) == len(q))
        for s, p, *_ in [x for x in scored if x[3] == lab][:positives]:
            fits = [x for x in scored if x[3] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, p, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def vectors(spark, rows, kind="int"):
    return spark.createDataFrame(rows, f"vec_id bigint, label {kind}, embedding array<double>")


def test_hard_negatives_with_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        v = rng.normal(size=8)
        v[0] += 2.5
        rows.append((i, int(i % 3), [float(x) for x in v / np.linalg.norm(v)]))
    hot = [0.5] * 4 + [0.5, 0.1, 0.0, 0.0]
    rows += [(1000 + 7 * i, i % 2, hot) for i in range(400)]  # a third of all rows is one vector, in two labels
    rows += [(5000, 1, hot)] * 150 + [(4, 0, hot)] * 200  # ids that repeat more often than a digit's spare rows
    rows += [(None, 1, hot), (50, None, hot), (100, 1, None), (150, 1, [0.1, None] + [0.0] * 6), (200, 1, [float("nan")] + [0.0] * 7), (250, 1, [float("inf")] + [0.0] * 7)]
    rows += [(300, 1, [0.5, 0.5]), (301, 1, [0.5, 0.5]), (302, 2, [0.4, 0.3]), (350, 1, []), (400, 2, [0.0] * 8)]
    got = hard_negatives.hard_negatives(clashing(vectors(spark, rows)))
    expected = mined(rows)
    assert len(expected) > 500 and sorted(map(tuple, got.collect())) == expected
    again = hard_negatives.hard_negatives(vectors(spark, rows).repartition(7))
    assert sorted(map(tuple, again.collect())) == expected
    assert hard_negatives.hard_negatives(vectors(spark, [])).count() == 0
    assert hard_negatives.hard_negatives(vectors(spark, [(1, 1, hot), (3, 2, hot)])).count() == 0  # no anchor
    few = [(50, 1, hot), (51, 1, hot), (52, 2, [x * 0.8 for x in hot])]
    assert sorted(map(tuple, hard_negatives.hard_negatives(vectors(spark, few)).collect())) == mined(few) != []
    named = vectors(spark, [(i, f"l{lab}", v) for i, lab, v in few], "string")
    assert hard_negatives.hard_negatives(named).count() == len(mined(few))
    with pytest.raises(InputError):
        hard_negatives.hard_negatives(vectors(spark, [(50, 1, [1e8] * 4)]))


def test_large_scores_and_wide_ids_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(int(50 * rng.integers(-(2**50), 2**50)) if i < 12 else int(rng.integers(-(2**60), 2**60)), int(rng.integers(3)), [float(x) for x in rng.integers(1, 100_000, 6)]) for i in range(260)]
    rows += [(int(i) * 50 + 1, 2, rows[0][2]) for i in range(100)]
    got = hard_negatives.hard_negatives(vectors(spark, rows))
    assert sorted(map(tuple, got.collect())) == mined(rows) != []


def test_selection_gathers_few_rows(spark):
    """Of 2,000 rows of one score a window gathers no more than the k wanted and the spare ones."""
    rows = vectors(spark, [(i, 0, [0.5, 0.5]) for i in range(2000)])
    space = hard_negatives.quantised(rows)
    one = space.rows.filter("vec_id = 50").select(F.col("rid").alias("a"), F.lit(0).cast("bigint").alias("w"), F.lit(True).alias("same"), F.lit(-(2**20)).cast("bigint").alias("low"), F.lit(2**20).cast("bigint").alias("high"))
    seen = []
    kept = hard_negatives.gathered

    def counted(*args):
        seen.append(kept(*args).count())
        return kept(*args)

    hard_negatives.gathered = counted
    try:
        assert [r.vec_id for r in hard_negatives.select_top(space, one, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    finally:
        hard_negatives.gathered = kept
    assert seen[0] <= 5 + hard_negatives.SPARE


# --- 12 ---------------------------------------------------------------------------------------------------------------


def check_packing(spark, docs, expected, length=4096):
    lib = tokenizers.Tokenizer.from_str(WORDS)
    sequences = packing.export_sequences(packing.pack_documents(docs, WORDS, length))
    rows = packing.pieces(sequences).collect()
    ids = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for _, t in expected]
    total = sum(map(len, ids))
    # gapless sequences, all full but the last
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_sequence) == list(range(-(-total // length)))
    for s, parts in by_sequence.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == (length if s < max(by_sequence) else total - length * s)
    # every id in one piece: pieces, from first to last, are the documents, with repeats
    pieces, documents = defaultdict(int), defaultdict(int)
    for r in rows:
        pieces[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    flat = {}
    for r in sequences.collect():
        assert len(r.ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else length)
        assert r.ids[r.n_tokens :] == [0] * (len(r.ids) - r.n_tokens)
        flat[r.sequence_id] = r.ids[: r.n_tokens]
    stream = [x for s in sorted(flat) for x in flat[s]]
    order = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    while at < len(order):
        first, have = order[at], 0
        assert first.start == 0
        begun = first.sequence_id * length + first.offset
        while have < first.doc_tokens:
            r = order[at]
            assert (r.doc_id, r.start) == (first.doc_id, have)
            have, at = have + r.length, at + 1
        assert have == first.doc_tokens
        documents[first.doc_id, tuple(stream[begun : begun + have])] += 1
    wanted = defaultdict(int)
    for (key, _), x in zip(expected, ids, strict=True):
        wanted[key, tuple(x)] += 1
    assert documents == wanted
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(stream[r.sequence_id * length + r.offset :][: r.length], "<u4").tobytes())
    cut = [r for r in rows if r.offset == 0 and r.start > 0]
    assert sorted(map(tuple, packing.boundary_records(sequences).collect()), key=str) == sorted(((r.sequence_id, r.doc_id, r.start) for r in cut), key=str)
    return rows


def test_packing_covers_every_id_once(spark, sf):
    docs = table(spark, sf, "documents")
    expected = [(r.doc_id, r.text) for r in docs.collect()]
    rows = check_packing(spark, docs.repartition(5), expected)
    assert {r.doc_id for r in rows} == {d for d, _ in expected}
    kept = packing.SEGMENT
    packing.SEGMENT = 3000  # windows over many segments
    try:
        check_packing(spark, docs.repartition(3), expected, 1024)
    finally:
        packing.SEGMENT = kept


def test_packing_learns_a_word_once():
    """The library is asked once for 200,000 words that come back in every batch; ids are its own, also once words are forgotten."""
    words = token_blocks.Words(WORDS)
    names = ["".join(chr(97 + i // 26**j % 26) for j in range(4)) for i in range(200_000)]
    texts = pa.array([" ".join(names[i : i + 1000]) for i in range(0, len(names), 1000)])
    odd = pa.array(["It's 日本 & more, MORE, more... ½ ... It's", None, "", "Übel übel, !! x!! 12 a1"])
    asked, lib, spaced = [], words.lib, words.spaced

    class Counted:
        def encode_batch_fast(self, some, **how):
            asked.extend(x for t in some for x in t.split())
            return spaced.encode_batch_fast(some, **how)

    words.spaced = Counted()
    expected = [[*e.ids, 2] for e in lib.encode_batch(texts.to_pylist(), add_special_tokens=False)]
    for _ in range(3):
        ids, counts = words.encode_all(texts, 2, packing.REMEMBERED)
        assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]
    assert len(asked) == len(names)
    expected = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in odd.to_pylist()]
    for most in (packing.REMEMBERED, 10, 10):
        ids, counts = words.encode_all(odd, 2, most)
        assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]
    assert len(words.known) < 30


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "no id"), (3, "word " * 9000), (4, "It's 日本 & more"), (5, "one")]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    check_packing(spark, docs, rows)
    check_packing(spark, docs.repartition(4, "doc_id"), rows, 64)
    names = spark.createDataFrame([("x", "a b"), ("y", None)], "doc_id string, text string")
    assert {r.doc_id for r in packing.pieces(packing.pack_documents(names, WORDS)).collect()} == {"x", "y"}
    assert packing.packed_pieces(names, WORDS).count() == 2
    for empty in (docs.limit(0), docs.filter("doc_id = -1")):
        assert packing.pieces(packing.pack_documents(empty, WORDS)).count() == 0


# --- 13 ---------------------------------------------------------------------------------------------------------------


def trie_of(rows):
    """Brute force: rows of (conv, turn, role, text) to nodes."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    nodes = {}
    for key, m in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(key))))
        kids = sum(len(k) == len(key) + 1 for k in below)
        nodes[key] = (min(m), len(key), min(members[key[:-1]]) if key else None, len(m), kids, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(nodes.values(), key=str)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")


def test_trie_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(0, 120):
        if c % 17 == 3:
            continue  # absent, sometimes a group's first
        for turn in range(int(rng.integers(1, 22)) if c % 4 else 2):
            rows.append((c, turn, ["user", "assistant", None][int(rng.integers(3))] if turn > 9 else "user", ["héllo", "", None, "same"][int(rng.integers(4))] if turn > 1 else "same"))
    rows += [(500 + i, t, "user", f"copy {t}") for i in range(90) for t in range(11)]  # a large group of copies
    rows += [(601, 0, "u", "x"), (602, None, "u", "x"), (602, 3, None, None), (None, 1, "u", "lost"), (603, None, None, None), (604, 2, "ab", "c"), (609, 2, "a", "bc")]
    rows += [(700, 1, "u", "again")] * 12  # rows that repeat: turns that repeat
    got = prefix_trie.rebuilt_trie(clashing(conversations(spark, rows)))
    expected = trie_of(rows)
    assert sorted(map(tuple, got.collect()), key=str) == expected
    again = prefix_trie.rebuilt_trie(conversations(spark, rows).repartition(6))
    assert sorted(map(tuple, again.collect()), key=str) == expected
    assert prefix_trie.rebuilt_trie(conversations(spark, [])).count() == 0
    turnless = [r for r in [(c, 0, "u", "x") for c in range(1000, 1060)] if r[0] % 5]  # no group has its first
    assert sorted(map(tuple, prefix_trie.rebuilt_trie(conversations(spark, turnless)).collect()), key=str) == trie_of(turnless)


def test_digests_stream_over_chunks(spark):
    """Ids of one node over many chunks and tasks, and of nodes that share a task."""
    kept = prefix_trie.CHUNK
    ends = written(spark.range(5000).selectExpr("case when id < 4000 then 7 else id % 3 end as node", "id * 3 - 200 as conv"), "ends")
    groups = defaultdict(list)
    for r in ends.collect():
        groups[r.node].append(r.conv)
    prefix_trie.CHUNK = 64
    try:
        got = {r.node: r.digest for r in prefix_trie.joined_digests(ends.repartition(5)).collect()}
    finally:
        prefix_trie.CHUNK = kept
    assert got == {n: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for n, v in groups.items()}


def test_dense_names_have_no_gaps(spark):
    rows = spark.range(1000).selectExpr("id % 137 as l", "id % 3 as r").repartition(4)
    names = prefix_trie.dense_names(rows, ["l", "r"]).collect()
    assert sorted(r.name for r in names) == list(range(137 * 3)) and len({(r.l, r.r) for r in names}) == 137 * 3
