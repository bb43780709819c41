"""Each training-data operator against a brute-force version, and on odd rows: nulls, empty and long texts, ties, no rows."""

import gzip
import hashlib
import re
import time
import zlib
from base64 import b32encode

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilwork.llm import components, hnsw, html_text, line_quality, mixing, pieces, simhash, token_blocks, toxicity, url_filter, warc
from veilwork.llm.common import table
from veilwork.llm.queries import URL_RULES, model_bytes

WORD = re.compile("[^\x20\x09-\x0d]+")
PIECES = model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
WORDS = model_bytes(public_tokenizers.path("word_bpe_49k.json")).decode()
#: Extra columns with the names that operators use inside.
CLASH = "n_words int, copy int, component int, fp int, id int, size int, part int, start int, key int, terms string, votes int, label int, block int, digest string, _id int, _copy int, row int, _row int, text_hash int, at int, host int, number int, n int"


@pytest.fixture(scope="module")
def odd(spark):
    long = "word " * 30_000 + "end"
    texts = [(1, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text here\n" * 20), (6, "same text here\n" * 20), (6, "same text here\n" * 20), (7, long), (None, "no id at all"), (8, "Ünï cödé 日本 😀 ▁ <s> it's"), (9, "idiot loser trash, you are a moron"), (9, "other text of one id")]
    rows = [(i, t, "en", None if i == 4 else f"s{i % 2 if i else 0}", len(t or ""), *[0] * 9, "x", 0, 0, 0, "x") for i, t in texts]
    rows = [(*r[:5], 1, 1, 1, 1, 1, 1, 1, 1, 1, "t", 1, 1, 1, "d", *[1] * 9) for r in rows]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}")


def docs_of(spark, sf):
    return table(spark, sf, "documents").collect()


@pytest.mark.parametrize("name", ["op1_url_filters", "op2_quality_rules", "op5_warc", "op6_mixing"])
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, found = entry.queries()[name](spark, sf), c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    a = [tuple(r[x] for x in order) for r in df.collect()]
    b = [tuple(r[names.index(x)] for x in order) for r in found.fetchall()]
    assert sorted(a, key=str) == sorted(b, key=str)


# --- 1 ----------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://Shop.Example.COM/en/7x", "http://example.com/en/6", "https://a.net/de/1?x", "https://example.net/de/8", "org/es/", None, "", "http://notexample.com/en/7", "http://x.org/es/#f", "http://", "ftp://com/en/", "http://com"]
    pages = spark.createDataFrame([(i, u, 1, 1) for i, u in enumerate(urls)], "page_id bigint, url string, key int, host int")
    for r in url_filter.filter_urls(pages, URL_RULES).collect():
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host, path = re.match("([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0
    twice = url_filter.filter_urls(pages.union(pages).repartition(5), URL_RULES)
    assert twice.count() == 2 * len(urls) and twice.distinct().count() == len(urls)
    assert url_filter.filter_urls(pages, []).filter("verdict = 'allow' and rule is null").count() == len(urls)
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, [("com", "/", "block"), ("com", "/", "allow")])


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.filter("cast(substring(key, 2) as int) % 97 = 0")
    cascade = url_filter.build_cascade(listed, universe)
    rows = url_filter.hashed(universe).toPandas()
    got = cascade.contains(rows.h1.to_numpy(), rows.h2.to_numpy())
    assert (got == (rows.key.str[1:].astype(int) % 97 == 0)).all() and len(cascade.levels) > 1
    assert sum(x.m for x in cascade.levels) < 60 * listed.count()


# --- 2 ----------------------------------------------------------------------------------------------------------------


def test_quality_counts(spark, odd):
    docs = {(r.doc_id, r.text) for r in odd.collect()}
    found = line_quality.line_quality(odd).collect()
    assert len(found) == odd.count()
    for r in found:
        text = next(t for i, t in docs if i == r.doc_id and (len(WORD.findall(t or "")) == r.n_words))
        w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else set(grams[:-1])
        covered = {i + k for i, g in enumerate(grams) if g in seen for k in range(3)}
        assert (r.word_chars, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert r.kept is False or not r.base_failed
    assert line_quality.line_quality(odd.limit(0)).count() == 0


def test_frequent_lines_reject_depleted_documents(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    menu = "\n".join(" ".join(f"{'abcdefghijkl'[k]}{x}" for x in "mnopqrs") for k in range(12))
    rows = [(i, menu + "\n" + " ".join(f"d{i}y{k}" for k in range(5)), "h") for i in range(30)]
    rows += [(100 + i, menu + "\n" + body(i), "h") for i in range(5)] + [(200, menu + "\nfew words", "other")]
    page = body(0).replace("w", "p") + "\n" + "\n".join(f"line {k} of a page with words" for k in range(9))
    rows += [(300 + i, page, "h") for i in range(40)]  # a boilerplate page of 40 documents
    rows += [(400, page, "elsewhere")] * 40  # one document, repeated
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = line_quality.kept_documents(docs)
    assert {r.doc_id for r in kept.collect()} == {100 + i for i in range(5)} | {200, 400}
    assert kept.filter("doc_id = 400").count() == 40


def test_frequent_passages_of_any_length_are_removed(spark):
    words = lambda x, n: " ".join(f"{x}w{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(n))
    rows = [(i, f"{words('p', 75)}\nown{chr(97 + i)} end", "h") for i in range(21)] + [(50, words("p", 75) + "\n" + words("q", 90), "h")]
    rows += [(100 + i, f"{words('r', 75)}\nown{chr(97 + i)} end", "h") for i in range(20)] + [(200, words("p", 75), "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: (r.removed_words, r.kept) for r in line_quality.line_quality(docs).collect()}
    expected = {i: (75, False) for i in range(21)} | {50: (75, True), 200: (0, True)} | {100 + i: (0, True) for i in range(20)}
    assert found == expected


# --- 3 ----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark, sf, odd):
    docs = docs_of(spark, sf)
    prints = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    arr, ids = np.array(list(prints.values()), np.uint64), list(prints)
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2)]
    expected = groups(ids, near)
    for r in simhash.simhash_components(table(spark, sf, "documents")).collect():
        assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], expected[r.doc_id])
    found = simhash.simhash_components(odd).collect()
    assert len(found) == odd.count() and {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.simhash_components(odd.limit(0)).count() == 0
    once = simhash.first_of_each(odd).collect()
    assert once[0].asDict().keys() == set(odd.columns) and sorted(r.doc_id for r in once if r.doc_id is not None and r.doc_id < 7) == [1, 4, 5]
    # rows of one id with unlike texts lie in groups of their own, so does the row without id
    assert sorted(r.text for r in once if r.doc_id == 9) == sorted(r.text for r in odd.collect() if r.doc_id == 9)
    assert [r.text for r in once if r.doc_id is None] == ["no id at all"]
    assert simhash.first_of_each(odd.limit(0)).count() == 0
    near = spark.createDataFrame([(None, "the same words once more"), (7, "the same words once more"), (7, "the same words once more"), (None, "alone here now")], "doc_id bigint, text string")
    assert sorted(map(str, simhash.first_of_each(near).collect())) == ["Row(doc_id=7, text='the same words once more')", "Row(doc_id=None, text='alone here now')"]


@pytest.mark.parametrize(("distance", "blocks", "most"), [(2, 5, 4), (2, 5, 64), (3, 6, 8), (1, 3, 4)])
def test_close_pairs_are_all_pairs(spark, distance, blocks, most):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40)
    prints = {int(b) for b in base}
    for b in base[:8]:  # dense balls around some
        for _ in range(60):
            x = int(b)
            for k in rng.integers(0, 63, rng.integers(1, 4)):
                x ^= 1 << int(k)
            prints.add(x)
    prints |= {int(base[9]) ^ (1 << i) for i in range(63)} | {int(base[9]) ^ (3 << i) for i in range(62)}
    prints = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)] + [-1, -(1 << 63), 0, 1]
    df = spark.createDataFrame([(p,) for p in set(prints)], "fp bigint")
    links = [(r.a, r.b) for r in simhash.close_pairs(df, distance, blocks, most).collect()]
    arr = np.array(sorted(set(prints)), np.int64)
    true = {(int(arr[i]), int(arr[j])) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count((arr ^ arr[i]).view(np.uint64)) <= distance) if j > i}
    assert len(links) == len(true) and set(links) == true


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(500, 620)] + [(700, i) for i in range(701, 900)]
    found = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    expected = groups({x for p in links for x in p}, links)
    assert all(found.get(i, i) == c for i, c in expected.items())
    assert found == {i: c for i, c in expected.items() if any(i in p and p[0] != p[1] for p in links)}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 2), (3, 3), (5, 4), (5, 4), (4, 5)], "a bigint, b bigint")
    assert sorted(map(tuple, components.connected_components(odd).collect())) == [(4, 4), (5, 4)]


# --- 4 ----------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, odd):
    lib = sentencepiece.SentencePieceProcessor(model_proto=PIECES)
    rows = pieces.encode_decode(odd, PIECES).collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    assert len(rows) == odd.count()
    for r in rows:
        text = next(t for t in texts[r.doc_id] if lib.encode(t, add_eos=True) == r.ids)
        raw = text.encode()
        assert r.decoded == lib.decode(r.ids)
        assert list(r.ends[:-1]) == list(r.starts[1:]) and r.starts[-1] == len(raw) == r.ends[-1]
        for i, a, b in zip(r.ids[:-1], r.starts, r.ends, strict=False):
            p = lib.id_to_piece(i)
            if not p.startswith("<0x"):
                assert raw[a:b].decode().replace(" ", "▁") in (p, p[1:])
    assert pieces.encode_decode(odd.limit(0), PIECES).count() == 0


def test_query_on_whole_documents_equals_the_library(spark, sf):
    lib = sentencepiece.SentencePieceProcessor(model_proto=PIECES)
    texts = {d.doc_id: d.text or "" for d in docs_of(spark, sf)}
    for r in entry.queries()["op4_sentencepiece"](spark, sf).collect():
        ids = lib.encode(texts[r.doc_id], add_eos=True)
        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), lib.decode(ids))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *hashes)


def test_character_map_equals_the_library():
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    proto = pieces.sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    m = pieces.CharMap(proto.normalizer_spec.precompiled_charsmap)
    for text in ("ﬁne ①②", "é　x", "日本 ｶﾞ", "plain", "", "a\tb\xa0c", "Ⅷ ㌔"):
        got, source = m.apply(text.encode())
        assert got.decode() == lib.normalize(text)
        assert len(source) == len(got) + 1 and list(source) == sorted(source) and source[-1] == len(text.encode())


# --- 5 ----------------------------------------------------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "x"), (2, "http://b\r\nWARC-Type: revisit", "x"), (3, None, None), (4, "u", ""), (5, "u", "Ünï 😀"), (5, "u", "Ünï 😀"), (6, "v", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    records = warc.read_archive(spark, path)
    facts = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_facts(records).collect())
    keeper = {}
    for i, _, h in rows:
        keeper[h or ""] = max(keeper.get(h or "", 0), i)
    sha = lambda h: b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    expected = [(i, len((h or "").encode()), sha(h), "response" if keeper[h or ""] == i else "revisit", None if keeper[h or ""] == i else keeper[h or ""]) for i, _, h in rows]
    assert facts == sorted(expected, key=lambda r: r[0])
    for r in records.collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(rest) == size + 4 and rest.endswith(b"\r\n\r\n")
    warc.export_warc(records, str(tmp_path / "warc"))
    back = warc.import_warc(spark, str(tmp_path / "warc")).collect()
    ids = {r.record_id: r for r in back}
    assert len(ids) == len(rows)  # repeated rows have ids of their own
    full = [bytes((ids[r.refers_to] if r.refers_to else r).payload).decode() for r in back]
    assert sorted((r.record_id.split(":")[2], r.record_type, t) for r, t in zip(back, full, strict=True)) == sorted((str(i), e[3], h or "") for (i, _, h), e in zip(rows, expected, strict=True))
    assert all(sha(t) == r.declared_sha1 for r, t in zip(back, full, strict=True))
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_only_cr_lf_ends_a_field_and_lengths_cut_records(spark, tmp_path):
    odd = [f"http://a{c}WARC-Refers-To: <urn:page:5:1>{c}WARC-Type: revisit{c}Content-Length: 1{c}" for c in ("\u2028", "\u2029", "\x85", "\n", "\r\n", "\x0b")]
    mark = "WARC/1.1\r\nWARC-Type: "
    html = [mark, f"about {mark}response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n{mark}", mark * 2000, "\r\n\r\n", "", None, "plain", "plain"]
    rows = [(i, odd[i % len(odd)], h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    found = {r.page_id: r for r in warc.page_facts(warc.read_archive(spark, path)).collect()}
    sha = lambda t: b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for i, _, h in rows:
        keeper = max(j for j, _, x in rows if (x or "") == (h or ""))
        assert (found[i].payload_bytes, found[i].payload_digest, found[i].refers_to) == (len((h or "").encode()), sha(h), keeper if keeper != i else None)
        assert found[i].record_type == ("revisit" if keeper != i else "response")
    warc.export_warc(warc.read_archive(spark, path), str(tmp_path / "warc"))
    back = warc.import_warc(spark, str(tmp_path / "warc")).collect()
    assert len(back) == len(rows) and all(r.payload is None or sha(bytes(r.payload).decode()) == r.declared_sha1 for r in back)
    assert sorted(bytes(r.payload).decode() for r in back if r.payload is not None) == sorted({h or "" for h in html})
    (tmp_path / "bad").mkdir()
    for i, f in enumerate((tmp_path / "warc").glob("*.gz")):
        (tmp_path / f"bad/{i}.txt").write_bytes(gzip.decompress(f.read_bytes()).replace(b"plain", b"plainer"))
    with pytest.raises(Exception, match="as long as its head|inside a record"):
        warc.import_warc(spark, str(tmp_path / "bad")).collect()


def test_damaged_payloads_stop_the_reading(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit("z").cast("binary")).write.parquet(f"{path}/other")
    (tmp_path / "archive/payloads").rename(tmp_path / "archive/old")
    (tmp_path / "archive/other").rename(tmp_path / "archive/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, path).collect()


# --- 6 ----------------------------------------------------------------------------------------------------------------


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, "d": 5, None: 400, "e": 0}
    found = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint"), (3, 1, 2), 1.5, 2).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        part = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if part[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            rest -= target[s]
            open_.remove(s)
    assert all(abs(found[s] - (target | part)[s]) < 1e-6 for s in order)


def test_mix(spark, odd):
    mix = mixing.mix_sources(odd)
    rows, slots = mix.documents.collect(), mix.schedule.collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert sum(x.words for x in slots if x.source == s) == sum(r.taken for r in own)
    again = mixing.mix_sources(odd.repartition(7)).documents.collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix_sources(odd.limit(0)).documents.count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mixed_documents(odd.limit(0)).count() == 0
    # rows of one id and size, which a target ends within: no word is lost
    same = spark.createDataFrame([(1, f"a{i} b c d e", "x") for i in range(7)] + [(2, "w " * 50, "y")], "doc_id bigint, text string, source string")
    taken = mixing.mix_sources(same).documents.collect()
    assert sum(len(WORD.findall(r.text)) for r in mixing.mixed_documents(same).collect()) == sum(r.taken for r in taken)


def test_early_slots_are_mixed(spark, sf):
    slots = mixing.mix_sources(table(spark, sf, "documents")).schedule.orderBy("slot").collect()
    n, all_ = len(slots), {}
    for s in slots:
        all_[s.source] = all_.get(s.source, 0) + 1
    for s, total in all_.items():
        half = sum(x.source == s for x in slots[: n // 2])
        assert abs(half - total / 2) < 12


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    vectors = [c + rng.normal(size=24) * s for c, s in zip(np.repeat(centres, 10, axis=0), rng.choice([0.02, 0.1, 0.25, 1], 600), strict=True)]
    vectors += [centres[0] + rng.normal(size=24) * 0.05 for _ in range(300)] + [centres[1]] * 40
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(vectors)]
    rows += [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 24, 1), (9004, [float("nan")] * 24, 1), (9005, [None] * 24, 1), (9006, rows[0][1], None), (9007, [1.0] * 3, 0), (9008, [float("inf")] * 24, 0)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, id int, n int")
    found = {r.vec_id: r for r in hnsw.embedding_components(df, shard=120).collect()}
    v = np.array([r[1] for r in rows[: len(vectors)]], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[: len(vectors)]])
    s = (v @ v.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(s, False)
    true = s.sum()
    got = sum(found[i].n_links for i in range(len(vectors)))
    assert true * 0.99 <= got <= true
    expected = groups(range(len(vectors)), list(zip(*np.nonzero(s), strict=True)))
    assert sum(found[i].component_id != expected[i] for i in expected) <= len(vectors) * 0.005
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i in range(9001, 9009))
    assert hnsw.embedding_components(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (4, [1.0, 0.0], 1), (6, [0.0, 2.0], 1)], "vec_id bigint, embedding array<double>, label int")
    rows = sorted((r.vec_id, r.n_links, r.component_id) for r in hnsw.embedding_components(twice).collect())
    assert rows == [(4, 1, 4), (5, 1, 4), (5, 1, 5), (6, 1, 5)]


def test_graph_recall():
    v = np.random.default_rng(3).normal(size=(1500, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g, _ = hnsw.build(v)
    q = g.vectors[::10]
    true = np.argsort(-(q @ g.vectors.T), axis=1)[:, :10]
    recall = [np.mean([len(np.intersect1d(a, b)) / 10 for a, b in zip(hnsw.beams(g, q, ef)[0], true, strict=True)]) for ef in (16, 64, 256)]
    assert recall == sorted(recall) and recall[-1] >= 0.95


def plain_walk(vectors, links, query, start, ef):
    """One query's beam, by its definition."""
    step, new = min(ef, max(hnsw.OPENED, ef // hnsw.PART)), set(start)
    seen, opened, beam = set(new), set(), []
    while True:
        beam = sorted(beam + [(-float(vectors[i] @ query), i) for i in new])[:ef]
        some = [i for _, i in beam if i not in opened][:step]
        if not some:
            return [i for _, i in beam]
        opened.update(some)
        new = {int(j) for i in some for j in links[i] if j >= 0} - seen
        seen |= new


def test_beams_equal_their_definition_in_blocks_that_fit_a_cache(monkeypatch):
    v = np.random.default_rng(7).normal(size=(600, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g, _ = hnsw.build(v)
    queries, start, compared, einsum = g.vectors[:256], np.arange(3 * 256).reshape(-1, 3) % 600, [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: compared.append(a.nbytes + b.nbytes) or einsum(how, a, b))
    ids, sims = hnsw._walk(g.vectors, g.levels[-1], queries, start, 40)
    assert ids.tolist() == [plain_walk(g.vectors, g.levels[-1], q, s, 40) for q, s in zip(queries, start.tolist(), strict=True)]
    assert (np.diff(sims) <= 0).all() and max(compared) <= 1 << 20 < sum(compared)
    few = hnsw._walk(g.vectors, g.levels[-1], queries[:5], start[:5], 600)[0]
    assert few.tolist() == [plain_walk(g.vectors, g.levels[-1], q, s, 600) for q, s in zip(queries[:5], start[:5].tolist(), strict=True)]


@pytest.mark.parametrize("n", [1, 2, 50, 700])
def test_shards_of_every_size_go_through_the_graph(n, monkeypatch):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 24)) + np.repeat(rng.normal(size=(-(-n // 10), 24)) * 6, 10, axis=0)[:n]
    unit, walks, walk = hnsw.unit_vectors(v), [], hnsw._walk
    monkeypatch.setattr(hnsw, "_walk", lambda *a: walks.append(len(a[2])) or walk(*a))
    s = hnsw.Shard(np.arange(n), np.arange(1, n + 1), v, 0.98, 12, 0.98)
    walks.clear()
    joins = s.own()
    links = (unit @ unit.T >= 0.98) & ~np.eye(n, dtype=bool)
    by_id = np.argsort(s.ids)
    assert sum(walks) >= n and (s.total[by_id] == links @ np.arange(1, n + 1)).all()
    assert groups(range(n), joins) == groups(range(n), list(zip(*np.nonzero(links), strict=True)))
    other = v[: n // 2 + 1] * 3 + rng.normal(size=(n // 2 + 1, 24)) * 0.01
    before, expected = s.total.copy(), hnsw.unit_vectors(other) @ unit.T >= 0.98
    total, _ = s.asked(np.arange(1000, 1000 + len(other)), np.full(len(other), 2), other)
    assert (total == expected @ np.arange(1, n + 1)).all()  # both ends of a link count it
    assert ((s.total - before)[by_id] == 2 * expected.sum(axis=0)).all()


def test_every_pair_of_shards_meets_once(spark):
    nodes = spark.createDataFrame([(i, 1, [1.0, float(i)], "a", 2) for i in range(300)], "node bigint, n bigint, v array<double>, label string, size int")
    rows = hnsw._asks(nodes, spark.createDataFrame([("a", 2, 130)], "label string, size int, blocks int")).collect()
    home = {r.node: r.block for r in rows if r.kind == 0}
    met = {}
    for r in rows:
        if r.kind == 1:
            met.setdefault(frozenset((r.block, home[r.node])), set()).add(r.block)
    held = set(home.values())
    assert all(len(x) == 1 for pair, x in met.items() if pair <= held)
    assert all(frozenset((a, b)) in met for a in held for b in held if a != b)
    assert {r.part for r in rows if r.kind == 0} == {0, 1, 2} and all(sum(r.kind == 0 and r.node == i for r in rows) == 3 for i in range(5))


# --- 8 ----------------------------------------------------------------------------------------------------------------


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 127, 128, 129, 5000):
        for top in (1, 2, 300, 49_408, 2**32):
            ids = rng.integers(0, top, n, dtype=np.uint32)
            ids[::13] = rng.integers(0, 2**32, len(ids[::13]), dtype=np.uint32)
            data = token_blocks.pack(ids)
            assert (token_blocks.unpack(data) == ids).all()
            assert (np.concatenate([token_blocks.unpack_block(data, i) for i in range(-(-n // 128))]) == ids).all()


def test_words_equal_the_library():
    lib, words = tokenizers.Tokenizer.from_str(WORDS), token_blocks.Words(WORDS)
    for text in ("It's a TEST, don't.", "a\x1cb \x0b c", "Éa éA ÉÀ", "<|endoftext|> x", "1 22 3.5", "ΑΣ Σ", "日本 😀!!", "", " \n", "é ́x", "word. word, word... (word)", "K\u212a \u212b Ÿ ß İ a\x85b a\u2028b", "x<|endoftext|>y a<| b|>", "a\0b \x1d", "foo's 'tis it'll) a'.", "\ufeffabc", "a\u200bb$$$ Wort,,"):
        assert words.encode(text) == lib.encode(text, add_special_tokens=False).ids
    texts = [None, "a b", "", "Long " * 5000, "b"]
    ids, sizes = words.encode_all(pa.array(texts), 1)
    assert [ids[b - n : b].tolist() for n, b in zip(sizes, np.cumsum(sizes), strict=True)] == [[*lib.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_texts_are_put_together():
    rows = [pa.RecordBatch.from_arrays([pa.array([1, 2, None]), pa.array(["x" * (5 << 20), None, ""])], ["a", "b"]), pa.RecordBatch.from_arrays([pa.array([3, 4]), pa.array(["y" * (9 << 20), "z"])], ["a", "b"])]
    found = [(k, [len(t or "") for t in texts.to_pylist()]) for k, texts in token_blocks._together(iter(rows))]
    assert found == [([1], [5 << 20]), ([2, None, 3], [0, 0, 9 << 20]), ([4], [1])]
    assert list(token_blocks._together(iter([]))) == []


def test_token_table(spark, sf, odd, tmp_path):
    lib = tokenizers.Tokenizer.from_str(WORDS)
    at = 0
    found = {r.doc_id: r for r in token_blocks.token_table(table(spark, sf, "documents"), WORDS).collect()}
    for d in sorted(docs_of(spark, sf), key=lambda d: d.doc_id):
        ids = [*lib.encode(d.text or "", add_special_tokens=False).ids, 1]
        r = found[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    token_blocks.write_tokens(odd, str(tmp_path / "t"), WORDS)
    rows = token_blocks.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert len(rows) == odd.count() and [r.doc_id or 0 for r in rows] == sorted(r.doc_id or 0 for r in rows)
    assert all(r.ids[-1] == 1 and r.n_tokens == len(r.ids) for r in rows)
    assert token_blocks.token_table(odd.limit(0), WORDS).count() == 0


# --- 9 ----------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in scored if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in held if a.toxic for b in held if not b.toxic]
    assert sum(pairs) / len(pairs) > 0.75 and sum(r.predicted for r in held if not r.toxic) <= 2


def test_toxicity_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (9, 1, 1), (9, 1, 0), (77, 0, 1), (None, 0, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = toxicity.score_toxicity(odd, known).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert max(rows, key=lambda r: r.score).doc_id == 9
        assert {r.predicted for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.filter("text is null or not text like 'idiot%'").count() == odd.count() - 1
    assert toxicity.drop_toxic(odd.limit(0), labels).count() == 0


def test_only_texts_that_can_have_a_label_move(spark, monkeypatch):
    plans, kept = {}, toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: plans.update({name: df}) or kept(df, name))
    docs = spark.range(-20_000, 20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.col("id")).alias("text"))
    docs = docs.unionByName(docs.filter("doc_id % 1000 = 1")).unionByName(spark.createDataFrame([(None, "no id"), (3, None)], "doc_id bigint, text string"))
    labels = docs.filter("doc_id % 100 = 1").selectExpr("doc_id", "cast(doc_id % 300 = 1 as int) as toxic")
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (10**9, 1)], "doc_id bigint, toxic int"))
    toxicity.fit_toxicity(docs, labels)
    found = plans["labelled"].groupBy("text", "toxic").count().collect()
    known = [i for i in range(-20_000, 20_000) if i - 100 * int(i / 100) == 1 and zlib.crc32(str(i).encode()) % 5]
    assert {(r.text, r["count"]) for r in found} == {(f"text of {i}", 1 + (i - 1000 * int(i / 1000) == 1)) for i in known}
    moved = toxicity._likely(docs, plans["labels"])
    assert len(known) < moved.count() < 2 * len(known) and moved.columns == docs.columns
    # in the plan: bits are looked up below the exchange of the texts
    plan = plans["labelled"]._jdf.queryExecution().sparkPlan().toString()
    assert "getbit" in plan[plan.index("SortMergeJoin") :]
    for kind in ("string", "int", "double", "decimal(20,2)"):
        same = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
        for ids in (labels, labels.withColumn("doc_id", F.col("doc_id").cast(kind))):
            assert toxicity._likely(same, ids).join(ids, "doc_id").count() == same.join(ids, "doc_id").count()
    assert toxicity._likely(docs, labels.limit(0)).count() == 0 and toxicity._likely(docs.limit(0), labels).count() == 0


def plain_label_model(votes, labels, rounds=25):
    """The posteriors by the model's definition, text by text: votes as tuples, labels 0, 1 or None."""
    n_voters, n = len(votes[0]), len(votes)
    known = [y for y in labels if y is not None]
    prior = (sum(known) + 1) / (len(known) + 10)
    same = {v: [labels[i] for i in range(n) if votes[i] == v and labels[i] is not None] for v in set(votes)}
    start = {v: (sum(y) + prior) / (len(y) + 1) if y else 0.8 if 1 in v else 0.05 for v, y in same.items()}
    post = [start[v] for v in votes]
    for _ in range(rounds):
        mass = [[float(y == c) if y is not None else p if c else 1 - p for y, p in zip(labels, post, strict=True)] for c in (0, 1)]
        count = lambda c, **at: sum(m for m, v in zip(mass[c], votes, strict=True) if all(v[int(k[1:])] == x for k, x in at.items()))
        own = [[[count(c, **{f"v{i}": a}) for a in range(3)] for i in range(n_voters)] for c in (0, 1)]
        both = {(c, i, j, a, b): count(c, **{f"v{i}": a, f"v{j}": b}) for c in (0, 1) for i in range(n_voters) for j in range(n_voters) for a in range(3) for b in range(3)}
        shared = lambda i, j: sum(m * np.log(m * sum(mass[c]) / own[c][i][a] / own[c][j][b]) for c in (0, 1) for a in range(3) for b in range(3) if (m := both[c, i, j, a, b]) > 0)  # noqa: E731, B023
        parents, inside = {0: 0}, [0]
        while len(inside) < n_voters:
            _, j, i = max((round(shared(i, j), 9), -j, -k) for k, i in enumerate(inside) for j in range(n_voters) if j not in inside)
            parents[-j] = inside[-i]
            inside.append(-j)
        chance = {}
        for c in (0, 1):
            for j in range(n_voters):
                drawn = [own[c][j][a] + (2.4 if a == 0 else 0.45 if a == (2, 1)[c] else 0.15) for a in range(3)]
                drawn = [x / sum(drawn) for x in drawn]
                for b in range(3):
                    given = [both[c, parents[j], j, b, a] + 4 * drawn[a] for a in range(3)]
                    for a in range(3):
                        chance[c, j, b, a] = drawn[a] if j == 0 else given[a] / sum(given)
        odds = [np.log(prior / (1 - prior)) + sum(np.log(chance[1, j, v[parents[j]], v[j]] / chance[0, j, v[parents[j]], v[j]]) for j in range(n_voters)) for v in votes]
        post = [1 / (1 + np.exp(-min(max(o, -30), 30))) for o in odds]
    return odds


def test_label_model_equals_its_definition():
    rng = np.random.default_rng(4)
    y = rng.random(160) < 0.3
    vote = lambda hit, miss: np.where(rng.random(160) < np.where(y, hit, miss), 1, 0)
    a = vote(0.7, 0.05)
    columns = [a, np.where(rng.random(160) < 0.9, a, vote(0.5, 0.2)), vote(0.6, 0.1), np.where(rng.random(160) < np.where(y, 0.1, 0.7), 2, 0)]
    votes = [tuple(int(x) for x in row) for row in zip(*columns, strict=True)]
    labels = [int(y[i]) if i % 3 == 0 else None for i in range(160)]
    codes = np.array([sum(x << 2 * k for k, x in enumerate(v)) for v in votes])
    patterns, at = np.unique(codes, return_inverse=True)
    labelled = np.bincount(at, [x is not None for x in labels])
    toxic = np.bincount(at, [x or 0 for x in labels])
    model = toxicity.fit_label_model(patterns, np.bincount(at), labelled, toxic, 4)
    assert np.allclose(model.odds(toxicity.unpack_votes(codes, 4)), plain_label_model(votes, labels), atol=1e-6)
    assert 0.05 <= model.scale < 20 and abs(model.shift) < 20


def test_a_voter_that_repeats_another_says_little():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    vote = lambda acc: np.where(rng.random(4000) < acc, y, ~y)
    a, b, c = vote(0.9), vote(0.8), vote(0.8)
    codes = a.astype(int) | a.astype(int) << 2 | b.astype(int) << 4 | c.astype(int) << 6  # two voters are one
    patterns, counts = np.unique(codes, return_counts=True)
    labelled = np.array([np.sum((codes == p)[:400]) for p in patterns])
    toxic = np.array([np.sum(((codes == p) & y)[:400]) for p in patterns])
    m = toxicity.fit_label_model(patterns, counts, labelled, toxic, 4)
    assert m.parents[1] == 0
    log = np.log(m.chances)
    assert abs(log[1, 1, 1, 1] - log[1, 0, 1, 1]) < 0.05 < 1 < log[2, 1, 0, 1] - log[2, 0, 0, 1]
    truth = np.array([y[codes == p].mean() for p in patterns])
    assert np.abs(m.posterior(toxicity.unpack_votes(patterns, 4)) - truth)[counts > 100].max() < 0.2


def test_terms_are_counted_over_all_labelled_rows(spark):
    rows = [(f"filler words here zorgle{'x' * (i % 2)}", 1) for i in range(8)] + [(f"filler words here and clean{i}", 0) for i in range(80)]
    docs = spark.createDataFrame(rows, "text string, toxic int")
    terms = toxicity.mine(docs).terms
    assert {"zorgle", "zorglex", "zorg*", "zorgl*"} <= set(terms) and not {"filler", "words", "here"} & set(terms)
    assert max(terms.values()) < len(toxicity.mine(docs).voters) <= 31
    with pytest.raises(ValueError, match="raise least"):
        toxicity.mine(docs, most=2)


def test_too_many_vote_patterns_are_an_error(spark, sf):
    with pytest.raises(ValueError, match="patterns of votes"):
        toxicity.fit_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"), most_patterns=3)


# --- 10 ---------------------------------------------------------------------------------------------------------------


def test_main_text(spark):
    cases = {
        "<nav><a href=x>menu</a></nav><article><h1>T</h1><p>One,  two\n three.<p>A &amp; B<br>c</article><footer>f</footer>": "T\nOne, two three.\nA & B c",
        '<div class="sidebar">x, y, z</div><div id="content"><p>Long text, with commas, and words.</p><p>More of it.</p></div><div class="comments"><p>nice, post, man</p></div>': "Long text, with commas, and words.\nMore of it.",
        "<script>var t='</p>';</script><style>p{}</style>": "",
        "": "",
        "<p>Only a paragraph</p>": "Only a paragraph",
        "<article><p>text, here</p><ul><li><a href=1>link one</a><li><a href=2>link two</a></ul><form><p>mail</p></form><ul><li>point one</li></ul></article>": "text, here\nlink one\nlink two\npoint one",
        "<article><p><b>open <i>never closed<p>next": None,
        "<!-- c --><article><p>a&nbsp;&lt;b&gt;</p></article>": "a <b>",
    }
    cases["<article><p><b>open <i>never closed<p>next"] = "open never closed\nnext"
    for html, text in cases.items():
        assert html_text.main_text(html) == text
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "<div>" * 3000 + "deep, text", 2), (2, None, "<p>x", 2)], "page_id bigint, url string, html string, text int")
    rows = {(r.page_id, r.text): r.n_chars for r in html_text.extract_text(pages).collect()}
    assert rows == {(1, ""): 0, (2, "deep, text"): 10, (2, "x"): 1}
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_main_text_outside_paragraphs():
    long = "A long article, with commas, and words. " * 5
    line = long.strip()
    cases = {
        f"<html><body>{long}<br>more text</body></html>": f"{line} more text",
        f"<nav><a href=x>menu</a></nav><center>{long}</center>": line,
        f"<body><span>{long}</span><div class=sidebar>x, y</div></body>": line,
        f"<font><b>{long}</b></font>": line,
        f"<address>{long}</address>": line,
        f"<div><span>{long}</span></div><ul><li><a href=1>one</a><li><a href=2>two</a></ul>": line,
        f"loose <b>text</b><div><span>{long}</span></div>end": f"loose text\n{line}\nend",
        "<article><p><a href=1>one, two</a></p><p><a href=2>three</a></p></article><footer>f</footer>": "one, two\nthree",
    }
    for html, text in cases.items():
        assert html_text.main_text(html) == text


def test_marks_weigh_and_comments_go():
    many = "".join(f"<p>long comment {i}, with, many, commas</p>" for i in range(30))
    cases = {
        '<div class="wrap has-sidebar"><article><p>One, two, three.</p></article></div>': "One, two, three.",
        '<section class="social-policy"><p>Policy text, long.</p></section>': "Policy text, long.",
        '<article><div class="entry-header"><h1>Title</h1></div><p>Body, text.</p></article>': "Title\nBody, text.",
        "<article><p>Body, text, words.</p><section><h2>Comments</h2><p>by bob: nice</p></section></article>": "Body, text, words.",
        "<article><p>Body, text, words.</p><div><header><h2>2 Comments</h2></header></div><p>by bob: nice</p>loose</article>": "Body, text, words.",
        "<article><p>Body.</p><h3>Kommentare (2)</h3><p>by bob</p><h2>Next part</h2><p>More.</p></article>": "Body.\nNext part\nMore.",
        "<article><h1>Comments</h1><p>An article, of that name.</p></article>": "Comments\nAn article, of that name.",
        f'<article><p>Short one.</p></article><div class="comments">{many}</div>': "Short one.",
        "<form><div><h1>T</h1><p>a page, in a form</p><p>as old, sites are</p></div></form>": "T\na page, in a form\nas old, sites are",
        '<body style="display:none"><p>a, b</p></body>': "a, b",
        f'<div class="sidebar"><h1>T</h1>{many}</div><div><p>c</p></div>': "T\n" + "\n".join(re.findall("<p>(.*?)</p>", many)),
        "<article><header><h1>T</h1></header><section><p>a, b, c</p></section><section><p>g</p></section><aside>no</aside></article><footer>f</footer>": "T\na, b, c\ng",
        '<div id=content><p>x, y, z</p><div class="share">share</div><div class="ad-banner">buy, this</div></div><div class=sidebar-left><p>q, w, e</p></div>': "x, y, z",
    }
    for html, text in cases.items():
        assert html_text.main_text(html) == text, html


BODY = "<p>The article's own text, which is long enough, with commas, to be one.</p><p>And a second paragraph, as long as the first one, or longer.</p>"
KEPT = "The article's own text, which is long enough, with commas, to be one.\nAnd a second paragraph, as long as the first one, or longer."


@pytest.mark.parametrize("mark", [f'class="{c}"' for c in (
    "user-comments reader-comments comment-body comment-content comment-thread commentsBlock CommentList google-ads sponsored-content related-articles related-posts "
    "share-buttons social-icons cookie-message newsletter-form dropdown-menu mobile-menu ad-slot-3 topAds main-nav post-comments promo_box cookieConsent"
).split()] + ["id=disqus_thread", "id=comments", "role=navigation", "hidden"])
def test_marked_parts_of_an_article_go(mark):
    part = f"<div {mark}><p>Something else, of some length, that isn't the article, but has commas.</p></div>"
    assert html_text.main_text(f"<article><h1>T</h1>{BODY}{part}</article>") == f"T\n{KEPT}"
    assert html_text.main_text(f"<div id=x><h1>T</h1>{part}{BODY}</div>") == f"T\n{KEPT}"


def test_what_an_article_keeps():
    cases = {f'<article><div class="{c}"><h1>Title</h1></div>{BODY}</article>': f"Title\n{KEPT}" for c in ("header", "page-header", "post-header", "main-header", "article-header")}
    cases |= {
        f'<article><h1>Title</h1><div class="header"><h2>Title</h2></div>{BODY}</article>': f"Title\n{KEPT}",
        f'<div class="header"><h1>Site</h1></div><article>{BODY}</article>': KEPT,
        f"<article>{BODY}<ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></article>": f"{KEPT}\none\ntwo",
        f"<div>{BODY}<ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></div>": f"{KEPT}\none\ntwo",
        f"<div><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>{BODY}</div>": KEPT,
        f"<article>{BODY}<h2>Responses</h2><p>The ministry gave three, of which, it said, none was final.</p></article>": f"{KEPT}\nResponses\nThe ministry gave three, of which, it said, none was final.",
        f"<article>{BODY}<p>Press <button>Start</button>, then <label>name</label> it.</p><button>Share</button></article>": f"{KEPT}\nPress Start, then name it.",
        f'<div class="layout sidebar-right"><main><h1>T</h1>{BODY}</main></div><div>(c) 2024, Some, Company, Inc.</div>': f"T\n{KEPT}",
        f'<div class="comments-open post"><h1>T</h1>{BODY}</div>': f"T\n{KEPT}",
        f"<article>{BODY}<section><h3>10:15</h3><p>News, of the hour.</p></section><section><h3>10:40</h3><p>More news.</p></section></article>": f"{KEPT}\n10:15\nNews, of the hour.\n10:40\nMore news.",
    }
    for html, text in cases.items():
        assert html_text.main_text(html) == text, html


def test_parts_with_many_siblings():
    """However many siblings a list has, a paragraph before it introduces it; however many parts a heading has, it is read."""
    links = "<ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>"
    split = "".join(f"<i>{c}</i>" for c in "3 Comments")
    cases = {
        f"<div>{BODY * 40}{links}</div>": "\n".join([KEPT] * 40) + "\none\ntwo",
        f"<div>{links}{BODY * 40}{links}<span></span><script>s</script>{links}</div>": "\n".join([KEPT] * 40) + "\none\ntwo",
        f"<article>{BODY}<section><h2>{split}</h2><p>by bob: nice</p></section></article>": KEPT,
    }
    for html, text in cases.items():
        assert html_text.main_text(html) == text, html
    began = time.process_time()
    assert html_text.main_text(f"<div>{BODY * 10_000}{links * 10_000}</div>").endswith("\none\ntwo")
    assert time.process_time() - began < 60


def test_comments_by_structure():
    one = lambda who, day, text: f"<div class=x><b>{who} says</b> <span>{day}</span><p>{text}</p></div>"
    two = one("Ann", "May 3, 2021", "I like it, a lot, and so on.") + one("Bob", "2021-05-04", "So do I, as it happens, and more.")
    item = lambda who, text: f"<li><em>{who}</em><time>yesterday</time><p>{text}</p><a href=r>Reply</a></li>"
    cases = {
        f"<article>{BODY}{two}</article>": KEPT,
        f"<article>{BODY}<ol>{item('Ann', 'First, of all.')}{item('Bob', 'Second, to that.')}</ol></article>": KEPT,
        f"<article>{BODY}<h2>Responses</h2>{one('Ann', '3 days ago', 'Only one, but a comment.')}</article>": KEPT,
        f"<article>{BODY}<h2>3 Responses</h2><p>by bob</p></article>": KEPT,
    }
    for html, text in cases.items():
        assert html_text.main_text(html) == text, html


def test_each_text_is_measured_once(monkeypatch):
    class Measured:
        texts, pattern = [], html_text.COMMA

        def findall(self, text):
            self.texts.append(text)
            return self.pattern.findall(text)

    monkeypatch.setattr(html_text, "COMMA", Measured())
    rows = "".join(f"<div>loose, {i}<p>para, {i} <b>bold, {i}</b></p><ul><li>item; {i}</li></ul></div>" for i in range(50))
    assert html_text.main_text(f"<article>{rows}</article>").count("\n") == 149
    assert len(Measured.texts) == len(set(Measured.texts)) == 200


def test_spaces_and_loose_texts():
    cases = {
        "<p>a\x1cb\u3000, \x85c  d</p> ": "a b , c d",
        "<main><h1>T</h1><p>Long text, with commas, and words that go on for a while.</p><h2>Comments</h2>loose, text <p>a comment</p> more, of it</main>": "T\nLong text, with commas, and words that go on for a while.",
        "<div>Loose, <b>bold, text</b>\x1f here <a href=1>link, </a><ul><li>x, y</li></ul>\n</div>": "Loose, bold, text here link,\nx, y",
        " \n\t ": "",
        "<div>\x85</div>": "",
    }
    for html, text in cases.items():
        assert html_text.main_text(html) == text, html


def plain_scores(tree):
    """Each element's score by its definition: every paragraph, wherever it is, and its distance."""
    size = lambda n: sum(len(" ".join(k.split())) if isinstance(k, str) else 0 if k.drop else size(k) for k in n.kids)
    commas = lambda n: sum(sum(k.count(c) for c in ",;") if isinstance(k, str) else 0 if k.drop else commas(k) for k in n.kids)
    links = lambda n: size(n) if n.tag == "a" else sum(links(k) for k in n.kids if not isinstance(k, str) and not k.drop)
    inside = lambda n, top: n is top or n.parent is not None and inside(n.parent, top)
    weight = lambda n: 0.1 if n.tag == "aside" else 0.01 if "sidebar" in n.like else 1
    out = {}
    for top in tree.nodes:
        total = 0.0
        for p in tree.nodes:
            if p.drop or not size(p) or not inside(p, top):
                continue
            gives = (1 + commas(p) + min(size(p) / 100, 3)) * (1 - links(p) / size(p))
            if p.tag in html_text.PARAGRAPHS:
                up, share = p.parent, weight(p)
            elif p.tag in ("div", "section", "article") and any(isinstance(k, str) and k.strip() for k in p.kids):
                up, share = p, 1.0
            elif p.tag == "aside" and (own := [" ".join(k.split()) for k in p.kids if isinstance(k, str) and k.strip()]):
                up, share, n = p, 1.0, sum(map(len, own))
                gives = 1 + sum(k.count(c) for k in own for c in ",;") + min(n / 100, 3)
            else:
                continue
            while up is not None and inside(up, top):
                if up is top:
                    total += gives * share
                up, share = up.parent, share / 2 * weight(up)
        around = min([weight(m) for m in tree.nodes if m is not top and inside(top, m)], default=1)
        out[top] = total * (1 - links(top) / size(top)) * weight(top) * around if size(top) and not top.drop else 0.0
    return out


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.integers(1, 4)):
        words = " ".join(rng.choice(["word", "other, word", "and; so", "text"], rng.integers(1, 40)))
        kind = rng.integers(0, 8)
        if kind < 3 or depth > 3:
            out.append(f"<p>{words}</p>" if kind else f"<ul><li><a href=1>{words}</a></li><li>{words}</li></ul>")
        elif kind == 3:
            out.append(f"<script>{words}</script>")
        else:
            tag = ["div", "section", "article", "aside", 'div class="sidebar"', "div id=content"][rng.integers(0, 6)]
            out.append(f"<{tag}>{words if rng.integers(0, 3) == 0 else ''}{random_page(rng, depth + 1)}</{tag.split()[0]}>")
    return "".join(out)


def test_scores_equal_their_definition_and_decide(spark, sf, monkeypatch):
    rng = np.random.default_rng(5)
    pages = [random_page(rng) for _ in range(150)]
    for html in pages:
        tree = html_text.Tree(html)
        html_text._measure(tree)
        html_text._score(tree)
        expected = plain_scores(tree)
        assert all(abs(n.score - expected[n]) < 1e-9 for n in tree.nodes)
    real = [r.html or "" for r in table(spark, sf, "pages").collect()]
    texts = [html_text.main_text(h) for h in pages + real]

    def drawn(tree):
        for n in tree.nodes:
            n.score = rng.random()

    monkeypatch.setattr(html_text, "_score", drawn)
    other = [html_text.main_text(h) for h in pages + real]
    assert sum(a != b for a, b in zip(texts, other, strict=True)) > 0.3 * len(texts)


def test_hostile_pages_take_linear_time():
    began = time.process_time()
    for page in ("<div>a, b" * 100_000, "<ul><li>a, b<p>x" * 40_000, "<p><b>x</i></u>" * 40_000, "<section><h2>Comments</h2><p>q" * 20_000, "<table><tr><td>a" * 20_000):
        assert html_text.main_text(page) is not None
    assert time.process_time() - began < 60


# --- the pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs, columns = table(spark, sf, "documents"), table(spark, sf, "documents").columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, sf), "stage-" + name.replace(" ", "-"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        seen.append((docs.collect(), out.collect()))
        docs = out
    base = {r.doc_id for r in line_quality.line_quality(table(spark, sf, "documents")).filter("kept").collect()}
    assert {r.doc_id for r in seen[0][1]} == base
    before, after = seen[2]
    assert len({r.doc_id for r in after}) == len(after)
    prints = {r.doc_id: plain_fingerprint(r.text) for r in before}
    left = [prints[r.doc_id] for r in after]
    arr = np.array(left, np.uint64)
    assert all((np.bitwise_count(arr ^ x) <= 2).sum() == 1 for x in arr)
    lib = sentencepiece.SentencePieceProcessor(model_proto=PIECES)
    sums = sorted(hashlib.sha256(" ".join(map(str, lib.encode(r.text or "", add_eos=True))).encode()).hexdigest() for r in seen[4][0])
    assert sums == sorted(r.ids_sha256 for r in seen[4][1])


def test_pipeline_on_odd_rows(spark, sf, odd):
    import corpus_pipeline

    texts = sorted((r.doc_id is None, r.doc_id, r.text or "") for r in odd.collect())
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns
        found[name] = out.collect()
        assert stage(spark, odd.limit(0), sf).count() == 0
    assert {r.doc_id for r in found["quality rules"]} <= {5, 6, 7} and len(found["toxicity"]) >= len(texts) - 1
    assert len(found["simhash near-dedup"]) == len({plain_fingerprint(t) for *_, t in texts})
    assert len(found["sentencepiece"]) == len(texts) and all(WORD.search(r.text) for r in found["mixing"])
