"""The pipeline's stages against a plain Python version, texts and kept ids
included; the reputation's posterior recomputed in plain Python."""
import collections
import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from filelake.llm import decontam, kneser_ney, urlrep

from plain import plain_kneser_ney

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rnd = random.Random(12)
    word = {"en": [f"en{i}" for i in range(40)], "fr": [f"fr{i}é" for i in range(40)]}

    def text(lang, n):
        return " ".join(word[lang][(a * a) % 40] for a in (rnd.randrange(40) for _ in range(n)))
    known = sorted({a * a % 40 for a in range(40)})
    passage = " ".join(f"en{known[(i * i // 3 + i * 5) % len(known)]}" for i in range(50))
    leak = " ".join(f"EN{known[(i * i + 2) % len(known)]}" for i in range(12))
    rows = [(i, text(lang := ("en", "fr")[i % 2], rnd.randrange(20, 90)), lang) for i in range(160)]
    rows += [(300 + i, " ".join(f"z{rnd.randrange(10 ** 6)}" for _ in range(60)), "en") for i in range(12)]   # noise
    rows += [(400 + i, rows[2 * i][1], "en") for i in range(5)]                                                # copies
    rows += [(500 + i, f"{rows[i][1]} {passage} {rows[i + 20][1]}", "en") for i in range(4)]                   # a passage of all
    rows += [(600 + i, f"{rows[40 + 2 * i][1]}\n{leak} {rows[60 + 2 * i][1]}", "en") for i in range(3)]     # of the benchmark
    rows += [(700, None, "en"), (701, "", None), (None, rows[3][1], "en"), (None, None, "fr"), (None, text("en", 50), "en"),
             (702, rows[8][1], "en"), (702, text("en", 40), "en"), (702, text("en", 40), "de")]
    return [(i, t, lang, "src", len(t) if t is not None else None) for i, t, lang in rows], leak


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder with the tables a run reads; documents have more columns, named as inner ones."""
    rows, leak = corpus()
    at = str(tmp_path_factory.mktemp("world"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_null", "_id", "_tk", "tk", "kept", "n", "items", "kept_text", "clean_text", "grp", "fp"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 160)] + [(300, 0, 0), (301, 1, 1), (None, 1, 0), (1, 1, None), (2, None, None), (9999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    bench = [(1, f"{leak} tail"), (2, None), (3, "short item")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def lower(text):
    return (text or "").encode().lower().decode()


def plain_quality(rows, spark, at):
    held = {r.doc_id: r.held for r in kneser_ney.trusted(spark.read.parquet(f"{at}/labels.parquet")).collect()}
    learned = {(r[0], r[1]) for r in rows if held.get(r[0]) is False and r[1] is not None}
    prob, _ = plain_kneser_ney([t for _, t in learned], kneser_ney.ORDER)

    def score(t):
        w = [None, None, *words(lower(t)), None]
        return len(w) - 2, sum(math.log10(prob(w[k - 2:k], w[k])) for k in range(2, len(w)))
    scores = [score(r[1]) for r in rows]
    calm = [(r[2], *s) for r, s in zip(rows, scores) if held.get(r[0])]
    mean = lambda xs: -sum(x[2] for x in xs) / sum(x[1] for x in xs)
    by = collections.defaultdict(list)
    for x in calm:
        by[x[0]].append(x)
    means, overall = {k: mean(v) for k, v in by.items()}, mean(calm)
    shrunk = lambda lang, n, s: (-s + kneser_ney.PRIOR_TOKENS * means.get(lang, overall)) / (n + kneser_ney.PRIOR_TOKENS)

    def top(xs):
        v = sorted(shrunk(*x) for x in xs)
        return v[max(0, math.ceil(kneser_ney.QUANTILE * len(v)) - 1)] + kneser_ney.MARGIN
    limit, rest = {k: top(v) for k, v in by.items()}, top(calm)
    return [r for r, s in zip(rows, scores) if shrunk(r[2], *s) <= limit.get(r[2], rest)]


def plain_near(rows):
    def print_of(t):
        w = lower(t).encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    prints = [print_of(r[1]) for r in rows]
    kinds = sorted(set(prints))
    group = {f: f for f in kinds}
    for a in kinds:
        for b in kinds:
            if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    best = {}
    for r, f in zip(rows, prints):
        rank = (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
        if group[f] not in best or rank < best[group[f]][0]:
            best[group[f]] = (rank, r)
    return [r for _, r in best.values()]


def plain_substrings(rows):
    count = collections.Counter(tuple(w[i:i + 35]) for w in (words(r[1]) for r in rows) for i in range(len(w) - 34))
    out = []
    for r in rows:
        w = words(r[1])
        hit = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i:i + 35])] > 1:
                hit[i:i + 35] = [True] * 35
        text = " ".join(x for x, h in zip(w, hit) if not h) if any(hit) else r[1]
        out.append((r[0], text, r[2], r[3], None if text is None else len(text)))
    return out


def plain_leaks(rows, items):
    windows = set()
    for t in items:
        w = decontam.WORD.findall(lower(t).encode())
        k = min(10, len(w))
        windows |= {tuple(w[a:a + k]) for a in range(len(w) - k + 1 if k else 0)}
    out = []
    for r in rows:
        text = (r[1] or "").encode()
        found = list(decontam.WORD.finditer(text.lower()))
        w, hit = [m.group() for m in found], [False] * len(found)
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in windows:
                    hit[a:a + k] = [True] * k
        new, at = b"", 0
        for m, h, after in zip(found, hit, [*hit[1:], False]):
            if h and at is not None:
                new, at = new + text[at:m.start()], None
            if h and not after:
                at = m.end()
        new = (new + text[at:]).decode() if any(hit) else r[1]
        out.append((r[0], new, r[2], r[3], None if new is None else len(new)))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_the_pipeline_equals_a_plain_version(spark, world):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{world}/documents.parquet")
    want = rows_of(docs)
    plain = {"quality": lambda rows: plain_quality(rows, spark, world), "near_dedup": plain_near, "substring_dedup": plain_substrings,
             "decontaminate": lambda rows: plain_leaks(rows, [r.text for r in spark.read.parquet(f"{world}/benchmark.parquet").collect()])}
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before, want = want, plain[name](want)
        docs = P.store(stage(spark, docs, world), "test")
        assert docs.columns == COLUMNS
        assert sorted(rows_of(docs), key=str) == sorted(want, key=str), name
        kept[name] = (before, want)
    # each stage had something to do, and left the rest alone
    ids = lambda rows: {r[0] for r in rows}
    assert {300, 305} & (ids(kept["quality"][0]) - ids(kept["quality"][1])) and {0, 1, 2, 700} <= ids(kept["quality"][1])
    assert {400, 401, 404} <= ids(kept["near_dedup"][0]) and not {400, 401, 404} & ids(kept["near_dedup"][1])
    assert sum(a != b for a, b in zip(*kept["substring_dedup"])) >= 4
    assert sum(a != b for a, b in zip(*kept["decontaminate"])) == 3 and "EN" not in str(want)
    assert any(r[0] is None for r in want)
    packed = P.run(spark, world).collect()
    tokens = collections.Counter()
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
    expected = collections.Counter()
    for r in want:
        expected[r[0]] += len(words(r[1]))
    assert tokens == expected


def plain_posterior(hosts, suffix_of, domain_of):
    """Beta-binomial shrinkage from all to suffix to domain to host, by the formulas."""
    bad, n = sum(b for _, b, _ in hosts), sum(k for *_, k in hosts)
    overall = (bad + 0.5) / (n + 1)

    def level(groups, prior):
        extra = sum((b - k * prior[g]) ** 2 - k * prior[g] * (1 - prior[g]) for g, (b, k) in groups.items())
        room = sum(k * (k - 1) * prior[g] * (1 - prior[g]) for g, (b, k) in groups.items())
        rho = min(max(extra / room if room else 0.5, 0.001), 0.9)
        weight = 1 / rho - 1
        out = {}
        for g, (b, k) in groups.items():
            x, y = prior[g] * weight + b, (1 - prior[g]) * weight + k - b
            out[g] = (x / (x + y), math.sqrt(x * y / ((x + y) ** 2 * (x + y + 1))))
        return out

    def summed(name):
        g = collections.defaultdict(lambda: [0, 0])
        for h, b, k in hosts:
            g[name(h)][0] += b
            g[name(h)][1] += k
        return {k: tuple(v) for k, v in g.items()}
    suffixes = summed(suffix_of)
    s = level(suffixes, dict.fromkeys(suffixes, overall))
    domains = summed(domain_of)
    d = level(domains, {x: s[suffix_of(x)][0] for x in domains})
    own = {h: (b, k) for h, b, k in hosts}
    return level(own, {h: d[domain_of(h)][0] for h in own})


@pytest.mark.parametrize("seed", range(3))
def test_reputation_is_the_beta_binomial_posterior(spark, seed):
    rnd = random.Random(seed)
    hosts = []
    for s in ("com", "org", "net"):
        for d in range(6):
            rate = rnd.betavariate(1, 3)
            for h in range(rnd.randrange(1, 7)):
                n = rnd.choice([0, 1, 3, 10, 200])
                hosts.append((f"h{h}.d{d}.{s}", sum(rnd.random() < rate for _ in range(n)), n))
    last = lambda k: lambda h: ".".join(re.split(r"\.", h)[-k:])
    want = plain_posterior(hosts, last(1), last(2))
    got = {r.host: (r.bad_rate, r.bad_low) for r in urlrep.host_reputation(spark.createDataFrame(hosts, "host string, bad long, n long")).collect()}
    assert got.keys() == want.keys()
    for h, (mean, sd) in want.items():
        assert got[h] == (pytest.approx(mean, rel=1e-9), pytest.approx(mean - urlrep.Z * sd, rel=1e-9, abs=1e-12))
