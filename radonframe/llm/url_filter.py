"""URL filters: rules first, then naive Bayes over the words of segmented host names and of paths.

1. Rules (host and path prefix; the longest that fits wins) decide what they cover, and label the training pages.
2. Unigram counts of the words of the pages' texts are a table. Every distinct run of letters in a host is cut into all substrings of up
   to ``SHORT`` letters, which a join looks up in that table; a longer word is found by its first ``SHORT`` letters and then
   compared in full, so no word or run is cut. A Viterbi pass per run takes the likeliest split. Runs of digits are words of their own.
3. Multinomial naive Bayes with add-one smoothing over the exact vocabulary, a table too: counts of each token by verdict over all pages
   that a rule decides. Log odds are joined to the tokens of the pages and added up by page, in units of 2 ** -32, so that the sums do
   not depend on their order. A token that no training page has says nothing.

Defined cases: a null url, or one without ``://``, has an empty host and path; null html has no words; with no training
pages every page without a rule is allowed, as are ties; repeated rows and null ids are rows like others; an empty
table gives an empty result; further columns are ignored. The same rule given twice with different verdicts is an error;
of fitting rules of one length, the one with the longer host wins. ``MAX_RULES`` bounds the rules, which tasks hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, stage

SHORT = 20
MAX_RULES = 1_000_000
UNIT = float(1 << 32)  # of log odds
COUNTER_ENTRIES = 400_000
VERDICTS = ("allow", "block")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of each page."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    return pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), _UPPER, _LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


class Rules:
    """(verdict, rule) pairs; a rule is a host and what follows it, a path prefix."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        by_host: dict[str, dict[str, str]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            if by_host.setdefault(host, {}).setdefault(slash + path, verdict) != verdict or verdict not in VERDICTS:
                raise ValueError(f"rule {rule!r}: {verdict!r}")
        self.by_host = {h: sorted(ps.items(), key=lambda x: -len(x[0])) for h, ps in by_host.items()}

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The rule that wins, and its verdict."""
        best: tuple[int, str | None, str | None] = (-1, None, None)
        while host:
            for prefix, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix):
                    if len(host) + len(prefix) > best[0]:
                        best = (len(host) + len(prefix), host + prefix, verdict)
                    break
            host = host.partition(".")[2]
        return best[1:]


def apply_rules(urls: DataFrame, rules: Rules) -> DataFrame:
    """(page_id, host, path, rule, ruled): ``urls`` with the rule that wins and its verdict, nulls where none fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rules.find(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))], ["page_id", "host", "path", "rule", "ruled"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, ruled string")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tag, word = re.compile(rb"<[^>]*>"), re.compile(rb"[a-z\x80-\xff]+")
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for b in batches:
        for html in b.column(0):
            counts.update(word.findall(tag.sub(b" ", html.as_py().encode().lower())))
            if len(counts) > COUNTER_ENTRIES:
                yield flush()
    yield flush()


def unigrams(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts (one string column): runs of letters outside of tags, A-Z lower-cased; characters beyond ASCII count as letters."""
    return texts.filter(F.col(texts.columns[0]).isNotNull()).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for number, label in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for lo in range(0, len(label), 1 << 12):
                at = [(k, n) for k in range(lo, min(lo + (1 << 12), len(label))) for n in range(1, min(SHORT, len(label) - k) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(at)), pa.array([x[0] for x in at], pa.int32()), pa.array([label[k : k + n] for k, n in at])], ["id", "at", "part"])


def best_split(label: str, found: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest words of a label. found: counts by (start, length); an unseen string of n letters has 10 ** -n of one count; ties go to the shorter last word."""
    ten, whole = math.log(10), math.log(total)
    ending: dict[int, list[tuple[int, int]]] = {}
    for (start, n), count in found.items():
        ending.setdefault(start + n, []).append((start, count))
    best: list[tuple[float, int]] = [(0.0, 0)]
    unseen = (0.0, 0)  # the best start of an unseen string, by its score plus what its letters would cost
    for end in range(1, len(label) + 1):
        unseen = max(unseen, (best[end - 1][0] + (end - 1) * ten, end - 1))
        options = [(unseen[0] - end * ten - whole, unseen[1])]
        options += [(best[start][0] + math.log(count) - whole, start) for start, count in ending.get(end, ())]
        best.append(max(options))
    words, end = [], len(label)
    while end:
        words.append(label[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) of distinct labels (strings of letters)."""
    total = max(counts.agg(F.sum("n")).first()[0] or 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [best_split(x["label"], {(f["at"], f["len"]): f["n"] for f in x["found"] or ()}, total) for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    labels = stage(labels.withColumn("id", F.monotonically_increasing_id()), "labels")
    size = F.length("word")
    parts = labels.select("id", "label").mapInArrow(_substrings, "id long, at int, part string")
    short = parts.join(counts.filter(size <= SHORT).withColumnRenamed("word", "part"), "part").select("id", "at", F.length("part").alias("len"), "n")
    longer = counts.filter(size > SHORT).withColumn("part", F.substring("word", 1, SHORT))
    same = F.substring(F.col("label"), F.col("at") + 1, size) == F.col("word")
    long = parts.filter(F.length("part") == SHORT).join(longer, "part").join(labels, "id").filter(same).select("id", "at", size.alias("len"), "n")
    found = short.unionByName(long).groupBy("id").agg(F.collect_list(F.struct("at", "len", "n")).alias("found"))
    return labels.join(found, "id", "left").select("label", "found").mapInArrow(run, "label string, words array<string>")


LABEL = r"[0-9]+|[^\x00-\x60\x7B-\x7F]+"


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words): the words of all runs of letters of each distinct host, and its runs of digits."""
    labels = hosts.select("host").distinct().select("host", F.posexplode(F.regexp_extract_all("host", F.lit(LABEL), F.lit(0))).alias("at", "label"))
    letters = ~F.col("label").rlike("^[0-9]")
    split = segment(labels.filter(letters).select("label").distinct(), counts)
    words = labels.join(split, "label", "left").withColumn("words", F.coalesce("words", F.array("label")))
    return words.groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))


def page_tokens(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(row, ruled, token) of pages (row, host, path, ruled), repeats included: the host's words, and the path's runs of letters and digits in lower case."""
    own = pages.join(hosts, "host").select("row", "ruled", F.explode(F.transform("words", lambda w: F.concat(F.lit("h "), w))).alias("token"))
    path = F.regexp_extract_all(F.lower("path"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return own.unionByName(pages.select("row", "ruled", F.explode(F.transform(path, lambda w: F.concat(F.lit("p "), w))).alias("token")))


def train(pages: DataFrame, tokens: DataFrame) -> tuple[int, DataFrame]:
    """Log odds of "block", in units: those of the classes, and a staged table (token, odds)."""
    allow, block = (F.count(F.when(F.col("ruled") == v, 1)) for v in VERDICTS)
    counts = stage(tokens.filter("ruled is not null").groupBy("token").agg(allow.alias("allow"), block.alias("block")), "urls")
    n = counts.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in VERDICTS], F.count("*").alias("distinct")).first()
    of = pages.agg(allow.alias("allow"), block.alias("block")).first()
    share = lambda v: F.log((F.col(v) + 1) / F.lit(float(n[v] + n["distinct"])))
    odds = stage(counts.select("token", F.round((share("block") - share("allow")) * UNIT).cast("long").alias("odds")), "urls")
    drop(counts)
    return round((math.log(of["block"] + 1) - math.log(of["allow"] + 1)) * UNIT), odds


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], seen: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds) of each page (page_id, url, html). seen: other texts to count words in."""
    urls = apply_rules(split_url(pages.withColumn("page_id", F.col("page_id").cast("long"))), Rules(rules))
    ruled = stage(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    counts = stage(unigrams((pages if seen is None else seen).select("html")), "urls")
    hosts = stage(host_words(ruled, counts), "urls")  # so that adaptive execution can split a hot host's rows
    tokens = stage(page_tokens(ruled.select("row", "host", "path", "ruled"), hosts), "urls")
    prior, odds = train(ruled, tokens)
    sums = stage(tokens.join(odds, "token").groupBy("row").agg(F.sum("odds").alias("odds")), "urls")
    drop(counts, hosts, tokens, odds)
    log_odds = (F.coalesce("odds", F.lit(0)) + F.lit(prior)) / UNIT
    judged = ruled.join(sums, "row", "left").withColumn("log_odds", log_odds)
    verdict = F.coalesce("ruled", F.when(F.col("log_odds") > 0, VERDICTS[1]).otherwise(VERDICTS[0]))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "log_odds")
