"""What the review of round 2 found cut short."""
import numpy as np
from pyspark.sql import functions as F

from filelake.llm import eftrie, recompress, urlrep


def test_texts_of_one_id_with_equal_short_hashes(spark, sf):
    import corpus_pipeline as P
    a, b = (" ".join(f"u{i}x{k}" for k in range(40)) for i in (9976, 151233))  # equal 32-bit Murmur hashes
    for i in (7, None):
        df = spark.createDataFrame([(i, a, "en", "s", 1), (i, b, "en", "s", 1), (8, f"{a} and more", "en", "s", 1)],
                                   "doc_id long, text string, lang string, source string, n_chars long")
        assert df.select(F.hash("text")).distinct().count() == 2
        got = {(r.text, r.n_removed) for r in recompress.dedup_substrings(df).collect()}
        assert got == {(a, 40), (b, 0), (f"{a} and more", 40)}
        kept = {r.text for r in P.near_dedup(spark, df, sf).collect()}
        assert b in kept and len(kept) > 1


def test_rare_successors_of_a_frequent_context_keep_their_probability():
    count = np.array([1, 2, 40, 3_000_000, 1_000_000_000], np.int64)
    name, context = np.arange(5, dtype=np.uint64) * np.uint64(999), np.full(5, 7, np.uint64)
    trie = eftrie.Trie.view(eftrie.Trie.build(context, name, count, 0.75).to_bytes())
    total, weight, codes = trie.ask(context[:1], np.array([5]), name)
    want = np.log10((count - 0.75) / count.sum())
    assert total[0] == count.sum() and np.abs(np.log10(eftrie.PROBABILITY[codes]) - want).max() <= 0.5 / eftrie.STEPS + 1e-9
    assert abs(np.log10(eftrie.weight(weight)[0]) - np.log10(0.75 * 5 / count.sum())) <= 0.5 / eftrie.FINE + 1e-9


def test_sites_below_a_suffix_of_two_labels_are_not_pooled(spark):
    hosts = ["a.bad.co.uk", "b.bad.co.uk:8080", "co.uk", "good.co.uk", "x.y.org", "org:80", "", "notco.uk", "n.d0.org:443"]
    suffix, domain = urlrep.site_parts(F.col("host"))
    got = {r.host: (r.s, r.d) for r in spark.createDataFrame([(h,) for h in hosts], "host string").select("host", suffix.alias("s"), domain.alias("d")).collect()}
    assert got == {"a.bad.co.uk": ("co.uk", "bad.co.uk"), "b.bad.co.uk:8080": ("co.uk", "bad.co.uk"), "co.uk": ("co.uk", "co.uk"),
                   "good.co.uk": ("co.uk", "good.co.uk"), "x.y.org": ("org", "y.org"), "org:80": ("org", "org"), "": ("", ""),
                   "notco.uk": ("uk", "notco.uk"), "n.d0.org:443": ("org", "d0.org")}
    rows = [(f"h{i}.d{i % 4}.co.uk", 20 * (i % 4 == 0), 20) for i in range(40)] + [("new.d0.co.uk:81", 0, 0), ("new.d1.co.uk", 0, 0)]
    rate = {r.host: r.bad_rate for r in urlrep.host_reputation(spark.createDataFrame(rows, "host string, bad long, n long")).collect()}
    assert rate["new.d0.co.uk:81"] > 0.5 > rate["new.d1.co.uk"]
