"""Token alignment, line dedup and spelling variants against brute force."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filelake.llm import linededup, spelling, tokalign


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def inputs(request, name, spark):
    if name == "sf":
        return spark.read.parquet(request.getfixturevalue("sf") + "/documents.parquet")
    df = request.getfixturevalue("clash" if name == "clash" else "docs")
    return df.limit(0) if name == "empty" else df


CASES = pytest.mark.parametrize("name", ["docs", "clash", "empty", "sf", "odd"])


def paths():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(spark, n=600):
    rnd = random.Random(4)
    abc = ["a", "b", " ", "  ", "\n", "\r", "\t", "é", "文", "字", "▁", " ", "　", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x0A>", "'s", "1", "23", "!",
           "...", "the ", " of", "ing", "\x00", "\x1c", "ﬁ", "😀", "Ġ", " ", "", " ."]
    rows = [(i, "".join(rnd.choice(abc) for _ in range(rnd.randrange(0, 25)))) for i in range(n)]
    return spark.createDataFrame([*rows, (9000, " "), (9001, "  lead and trail  "), (9002, " a"), (9003, "a "), (None, "x y")], "doc_id long, text string")


def aligned(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    a_path, b_path = paths()
    ta, tb = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    ta.encode_special_tokens = True
    value, per, held = tokalign.byte_values(), [], collections.Counter()
    for i, t in rows:
        t = t or ""
        a, b = ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)
        raw_a = [bytes(value[c] for c in ta.id_to_token(x)) for x in a]
        raw_b = [bytes([int(p[3:5], 16)]) if tb.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [tb.id_to_piece(x)]]
        if not t or not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            per.append((i, None))
            continue
        ra, rb = ([(int(e) - len(x), int(e)) for x, e in zip(raw, np.cumsum([len(x) for x in raw]))] for raw in (raw_a, raw_b))
        groups, links, p, q = [], [], 0, 0
        for end in sorted({y for _, y in ra} & {y for _, y in rb}):
            x, y = p, q
            while x < len(ra) and ra[x][1] <= end:
                x += 1
            while y < len(rb) and rb[y][1] <= end:
                y += 1
            groups.append(f"{','.join(map(str, a[p:x]))}|{','.join(map(str, b[q:y]))}")
            links += [(a[k], b[m]) for k in range(p, x) for m in range(q, y) if ra[k][0] < rb[m][1] and rb[m][0] < ra[k][1]]
            p, q = x, y
        per.append((i, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
        held.update(set(links))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if r is None else
            (i, *r[:3], len(r[3]), sum(held[k] == most[k[0]] for k in r[3]), sum(held[k] for k in r[3]), r[4]) for i, r in per]


@CASES
def test_token_alignment(request, spark, name, monkeypatch):
    df = odd_texts(spark) if name == "odd" else inputs(request, name, spark)
    if name == "odd":  # many blocks, parts encoded together and apart
        monkeypatch.setattr(tokalign, "BLOCK_PARTS", 50)
        monkeypatch.setattr(tokalign, "JOIN_BYTES", 64)
        monkeypatch.setattr(tokalign, "ADD_BYTES", 300)
    got = [tuple(r) for r in tokalign.align_texts(df, *paths()).collect()]
    assert sorted(got, key=str) == sorted(aligned(rows_of(df)), key=str)


def test_slices_and_links():
    a, b = np.array([2, 5, 6, 9, 12]), np.array([1, 2, 4, 6, 7, 12])
    x, y = tokalign.common_slices(a, b)
    assert list(zip(x.tolist(), y.tolist())) == [(1, 2), (3, 4), (5, 6)]
    i, j, many = tokalign.slice_links(a, b, x, y)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 5)] and many.tolist() == [2, 3, 3]


SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_common_lines(rows, least, shortest=1):
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(SPACE).translate(LOWER)
    count = collections.Counter(k for _, ls in lines for k in {key(x) for x in ls})
    out = []
    for i, ls in lines:
        kept = [x for x in ls if len(key(x)) < shortest or count[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def line_documents(spark, n=90):
    rnd = random.Random(7)
    pool = ["", " ", "All rights reserved", " all RIGHTS reserved\t", "\x0bx", "É", "é", "\xa0", "x\r", *(f"line {k}" for k in range(40))]
    rows = [(i if i % 9 else None, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 9)))) for i in range(n)]
    rows += [(500, "same\nsame\nrow")] * 5 + [(501, None), (502, "\n\n"), (503, "\n".join(["deep"] * 3000))]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("least, batches, fan_in", [(3, 8, 2), (10, 8, 4), (1, 2, 4), (2, 1, 2)])
@CASES
def test_line_dedup(request, spark, name, least, batches, fan_in):
    if name != "odd" and (least, batches) != (3, 8):
        pytest.skip("settings are varied on the odd lines")
    df = line_documents(spark) if name == "odd" else inputs(request, name, spark)
    r = linededup.drop_common_lines(df, least, batches=batches, fan_in=fan_in)
    got = [tuple(x) for x in linededup.kept_digest(r).collect()]
    assert sorted(got, key=str) == sorted(without_common_lines(rows_of(df), least), key=str)
    if name == "clash":
        assert set(df.columns) - {"n_lines", "n_dropped", "kept_text", "_tk"} <= set(r.columns)


def test_line_dedup_beyond_the_broadcast_bounds(spark, monkeypatch):
    from filelake import session
    monkeypatch.setattr(linededup, "join_side", lambda rows, side, on, how="inner", tag="side", **_: session.join_side(rows, side, on, how, tag, max_rows=1, hot_rows=20))
    df = line_documents(spark)
    got = [tuple(x) for x in linededup.kept_digest(linededup.drop_common_lines(df, 3)).collect()]
    assert sorted(got, key=str) == sorted(without_common_lines(rows_of(df), 3), key=str)


def test_runs_are_merged_without_moving_them(spark):
    runs = linededup.LineRuns(spark, min_docs=3, fan_in=3)
    batch = lambda *keys: spark.createDataFrame([(k,) for k in keys], "h string")
    runs.add(batch("a", "a", "a", "b"))
    plan = spark.createDataFrame([("a", 1)], "h string, n long").repartition(runs.buckets, "h")
    text = runs.unsettled(plan)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange") == 1  # the batch's own
    assert [r.h for r in runs.unsettled(plan).collect()] == []
    runs.add(batch("b", "c", "a"))  # a is settled: not counted again
    assert sorted((r.h, r.n) for r in runs.read(runs.runs[1]).collect()) == [("b", 1), ("c", 1)]
    runs.add(batch("b", "d"))
    assert [len(x) for x in runs.levels] == [0, 1]  # compacted
    assert sorted((r.h, r.n, r.done) for r in runs.read(runs.runs[0]).collect()) == [("a", 3, True), ("b", 3, True), ("c", 1, False), ("d", 1, False)]
    runs.add(batch("c", "c"))
    assert sorted(r.h for r in runs.common().collect()) == ["a", "b", "c"]
    runs.close()


def grouped(rows, often=3):
    c = collections.Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 97 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            if len(r) >= 5:
                c[r] += 1
    return forms({w: n for w, n in c.items() if n >= often})


def forms(c):
    by, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in c:
        for k in range(len(w)):
            by[w[:k] + "*" + w[k + 1:]].add(w)
    for w in c:
        for k in range(len(w)):
            near[w] |= by[w[:k] + "*" + w[k + 1:]] - {w}
            if w[:k] + w[k + 1:] in c:
                near[w].add(w[:k] + w[k + 1:])
                near[w[:k] + w[k + 1:]].add(w)
    form = {}
    for w, n in c.items():
        best = min(near[w], key=lambda x: (-c[x], x), default=None)
        form[w] = best if best is not None and c[best] >= 2 * n else None
    out = []
    for w, n in c.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), c.get(form[w])))
    return out


@pytest.mark.parametrize("name", ["docs", "clash", "empty", "sf"])
def test_spelling_variants(request, spark, name):
    df = inputs(request, name, spark)
    got = [tuple(r) for r in spelling.spelling_variants(df).collect()]
    assert sorted(got) == sorted(grouped(rows_of(df)))


@pytest.mark.parametrize("letters, frequent, split, shard", [("ab", 2, 3, 40), ("abcé", 5, 300_000, 400_000), ("a", 1, 2, 10), ("abÿ×", 50, 7, 1000)])
def test_spelling_of_dense_vocabularies(spark, letters, frequent, split, shard):
    """Words that are nearly all near one another, through many shards and split lists."""
    rnd = random.Random(len(letters))
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(5, 13))) for _ in range(500)}
    words |= {letters[0] * k for k in range(5, 40)} | {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149, "y" * 4000}
    c = {w: rnd.choice([3, 3, 4, 6, 7, 12, 50, 200]) for w in words}
    df = spark.createDataFrame(list(c.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(df, frequent=frequent, split=split, shard_rows=shard).collect()]
    assert sorted(got, key=str) == sorted(forms(c), key=str)


def test_a_word_asks_by_grams_that_one_edit_cannot_all_touch(spark):
    words = ["".join(random.Random(k).choice("abc") for _ in range(5 + k % 9)) for k in range(400)]
    limit, levels = spelling.gram_dictionary(spark.createDataFrame([(w, 3) for w in set(words)], "word string, n long"), frequent=5)
    assert len(levels) > 2 and all(len(h) for h, _ in levels[:-1])
    for n, rows, m in spelling._matrices(words):
        for lp, ll, rp, rl in zip(*spelling.choose(m, levels, limit)):
            spans = [(int(lp), int(ll)), (int(rp), int(rl))]
            assert spelling.affected_bound(spans) < len(spans) and all(0 <= a and a + k <= n for a, k in spans)


def test_parts_of_a_text_join_to_it():
    pair = tokalign.Pair(*paths())
    assert pair.splits
    for t in ["a b", " a", "a ", "  a  b ", "a\n b", "a \n", "\n", "x　 y"]:
        assert " " + " ".join(pair.parts(t)) == " " + t


def test_queries_are_registered():
    from filelake.llm.queries import ORACLE, QUERIES
    assert {"op11_token_alignment", "op12_line_dedup", "op13_spelling_variants"} <= set(QUERIES) and "op12_line_dedup" in ORACLE


def archive_files(pages, **options):
    from filelake.llm import warc
    from filelake.llm.common import shared_folder
    m = warc.write_archive(pages, shared_folder(pages.sparkSession, "test-warc"), **options)
    return m, sorted((r.shard, r.seq, r.records, r.bytes, r.sha256) for r in m.collect())


def test_archives_do_not_depend_on_splits_or_samples(spark):
    from filelake.llm import warc
    base = spark.range(50_000).select(
        F.when(F.col("id") % 97 != 0, F.col("id") % 40_000).alias("page_id"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("http://h/"), (F.col("id") % 7000).cast("string"))).alias("url"),
        F.when(F.col("id") % 13 != 0, F.repeat(F.md5((F.col("id") % 9000).cast("string")), (F.col("id") % 60).cast("int"))).alias("html"))
    options = {"roll_bytes": 300_000, "shard_bytes": 4_000_000}
    m, first = archive_files(base, **options)
    assert len({x[0] for x in first}) > 8 and sum(x[2] for x in first) == 50_000
    assert archive_files(base, **options)[1] == first
    assert archive_files(base.repartition(13, F.col("url")).orderBy(F.rand(5)), **options)[1] == first
    got = warc.read_archive(m).groupBy("page_id", "payload_digest", "record_type", "refers_to").count()
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = base.select("page_id", digest.alias("payload_digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    top = rows.where("n >= 1000").groupBy("payload_digest").agg(F.max("page_id").alias("top"))
    to = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    want = (rows.join(top, "payload_digest", "left").select("page_id", "payload_digest", F.when(to.isNull(), "response").otherwise("revisit").alias("record_type"), to.alias("refers_to"))
            .groupBy("page_id", "payload_digest", "record_type", "refers_to").count())
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_archives_cut_a_record_of_many_copies(spark):
    from filelake.llm import warc
    rows = [(5, "u", "x" * 1500)] * 700 + [(None, None, None)] * 500 + [(9, "u", "x" * 1500)] * 3 + [(1, "v", "y")] * 4
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    m, first = archive_files(pages.repartition(3), shard_bytes=60_000, hot_copies=30)
    assert archive_files(pages.repartition(11), shard_bytes=60_000, hot_copies=30)[1] == first
    assert max(x[2] for x in first) <= 150 and sum(x[2] for x in first) == len(rows)
    got = collections.Counter((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(m).collect())
    assert got == {(5, "u", 1500, "revisit", 9): 700, (None, None, 0, "response", None): 500, (9, "u", 1500, "response", None): 3, (1, "v", 1, "response", None): 4}


@pytest.mark.parametrize("tokens, hot", [(200, 10_000), (50, 10_000), (400, 6)])
def test_scores_do_not_depend_on_how_contexts_are_dealt(spark, monkeypatch, tokens, hot):
    from filelake.llm import lmscore
    rnd = random.Random(3)
    words = ["the"] * 30 + ["of"] * 9 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    train = F.col("doc_id") % 4 != 0
    key = lambda r: (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out)
    whole = {k: sorted(lmscore.score_texts(df, train, order=k).collect(), key=key) for k in (2, 3)}
    monkeypatch.setattr(lmscore, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lmscore, "MOST_HOT", hot)
    blocks = lmscore.encode_blocks(df, train)
    total = blocks.agg(F.sum("tokens")).first()[0]
    names, deals = lmscore.hot_contexts(blocks, total, tokens, hot)
    assert len(names) >= 1 and deals.max() > 2 and len(names) <= 2 * hot
    for k, rows in whole.items():
        dealt = sorted(lmscore.score_texts(df, train, order=k).collect(), key=key)
        for a, b in zip(rows, dealt):
            assert key(a) == key(b) and a.base_score == pytest.approx(b.base_score, abs=1e-9)
            assert abs(a.score - b.score) <= 0.035 * a.n_tokens  # both are quantised


def test_counts_beyond_32_bits_and_whole_names():
    from filelake.llm import eftrie
    name = np.array([5 << 24, (5 << 24) + 1, (5 << 24) + 77, 6 << 24, 1 << 63], np.uint64)
    count = np.array([1 << 33, 1, 3_000_000_000, 3_000_000_000, 2], np.int64)
    trie = eftrie.Trie.view(eftrie.Trie.build(np.array([9, 9, 9, 9, 4], np.uint64), name, count, 0.75).to_bytes())
    ask = np.concatenate([name, np.array([(5 << 24) + 2, 0, 7 << 24], np.uint64)])
    total, weight, codes = trie.ask(np.array([9, 4], np.uint64), np.array([7, 1]), np.concatenate([ask[[0, 1, 2, 3, 5, 6, 7]], ask[4:5]]))
    assert total.tolist() == [(1 << 33) + 6_000_000_001, 2]
    want = (count - 0.75) / np.array([total[0]] * 4 + [2.0])
    got = eftrie.PROBABILITY[codes]
    assert np.abs(np.log10(got[[0, 1, 2, 3, 7]]) - np.log10(want)).max() <= 0.5 / eftrie.STEPS + 1e-9 and not got[4:7].any()
