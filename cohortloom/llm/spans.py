"""Long exact spans shared between records: a log-structured index of window fingerprints.

A text's windows of ``gram`` characters are hashed and winnowed: of every ``least - gram + 1`` neighbouring windows the one
of the smallest hash is kept, so two texts that share ``least`` characters keep a common window. The index holds sorted
immutable runs of (hash, document, place), bucketed by hash. A new batch becomes a run and is merge-joined with itself and
with each run before it; both are semi-joins, so a hash in k documents gives k places and never k x k pairs. Runs are
compacted when there are too many.

The places are verified on the texts: the window by a second hash over a prime field (126 bits together), the ``least - gram``
characters at either side character by character. Places of equal windows are compared with each other while they are few
(``SMALL``, so at most SMALL / 2 comparisons a place); beyond that every window of ``least`` characters around them is hashed
twice and is shared if another document has it, and pairs are formed only where a shared stretch begins, once a stretch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.session import drop_path, stage, staged_path

#: Most documents whose ids are broadcast to fetch their texts; beyond it the texts are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Most places of one window that are compared with each other; more are verified by hashes of all windows around them.
SMALL = 200
#: A window in more documents than this is joined in blocks (salted) instead of within one task.
HOT = 2_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_CHUNK = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse modulo 2 ** 64."""

    def __init__(self, n: int) -> None:
        inv = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, inv, np.uint64)]))


def _window_hashes(code: np.ndarray, size: int, powers: _Powers) -> np.ndarray:
    """Hash of the window of ``size`` characters at each place: a polynomial modulo 2 ** 64 over mixed characters, by prefix sums."""
    n = len(code)
    with np.errstate(over="ignore"):
        term = _mix(code.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * powers.up[:n]
        total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(term)])
        return _mix((total[size:] - total[:-size]) * powers.down[: n - size + 1])


def winnow(code: np.ndarray, end: np.ndarray, gram: int, least: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Kept windows of texts laid end to end: positions (of the window's first character) and hashes.

    ``code``: code points; ``end``: for each character, where its text ends. A window never crosses the end of a text."""
    n, w = len(code), least - gram + 1
    if n < least:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _window_hashes(code, gram, powers)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % w
    block = np.concatenate([key, np.full(pad, _MASK, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: len(key) - w + 1], left[w - 1 : len(key)])  # the least key of w windows from each place on
    place = np.arange(len(low))
    low = low[end[place] - place >= least]
    if not len(low):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.unique(low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    return at, h[at]


def fingerprints(docs: DataFrame, doc: str, text: str, *, least: int = 400, gram: int = 300) -> DataFrame:
    """The kept windows of every text of at least ``least`` characters: ``doc``, ``h`` (hash), ``at`` (first character)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers(_CHUNK)

        def flush(ids: list, texts: list[str]) -> pd.DataFrame:
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            stop = np.cumsum(sizes)
            own = powers if len(code) <= _CHUNK else _Powers(len(code))
            at, h = winnow(code, np.repeat(stop, sizes), gram, least, own)
            which = np.searchsorted(stop, at, side="right")
            return pd.DataFrame({"doc": np.array(ids)[which], "h": h.view(np.int64), "at": at - (stop - sizes)[which]})

        for b in batches:
            ids, texts, size = [], [], 0
            for d, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                if size and size + len(t) > _CHUNK:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(d)
                texts.append(t)
                size += len(t)
            if ids:
                yield flush(ids, texts)

    kind = dict(docs.dtypes)[doc]
    return docs.select(doc, text).where(f"length({text}) >= {least} and {doc} is not null").mapInPandas(work, f"doc {kind}, h long, at int")


#: A prime field and two bases for the windows' second hash.
_PRIME, _BASES = (1 << 31) - 1, (911_382_323, 972_663_749)


class _Field:
    """Powers of ``_BASES`` and of their inverses over the prime field."""

    def __init__(self, n: int) -> None:
        self.size, self.tables = n, [(self._powers(b, n), self._powers(pow(b, -1, _PRIME), n)) for b in _BASES]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n + 1:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME)])
        return out[: n + 1]

    def hashes(self, code: np.ndarray, size: int) -> np.ndarray:
        """62 bits of each window of ``size`` characters."""
        p, n, out = np.uint64(_PRIME), len(code), np.zeros(len(code) - size + 1, np.uint64)
        for up, down in self.tables:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code.astype(np.uint64) * up[:n] % p)])
            out = (out << np.uint64(31)) | ((total[size:] - total[:-size]) % p * down[: n - size + 1] % p)
        return out


def _with_texts(places: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, t (text), hs and ats (places, alike in order). Each document with places is fetched once; up to
    ``MAX_BROADCAST_IDS`` places are broadcast, beyond it the texts are joined by a shuffle."""
    by_doc = places.groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("p"))  # at most one a character of the text
    by_doc = by_doc.select("doc", F.col("p.h").alias("hs"), F.col("p.at").alias("ats"))
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("t")).where("doc is not null")
    return texts.join(F.broadcast(by_doc) if places.count() <= MAX_BROADCAST_IDS else by_doc, "doc").select("doc", "t", "hs", "ats")


def contexts(places: DataFrame, docs: DataFrame, doc: str, text: str, *, least: int, gram: int) -> DataFrame:
    """The places with what is needed to verify them: ``h2`` (second hash of the window), ``left`` (the ``least - gram`` characters
    before it, backwards) and ``right`` (those after it)."""
    reach = least - gram

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = _Field(1 << 14)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for d, t, hs, ats in zip(b["doc"], b["t"], b["hs"], b["ats"], strict=True):
                code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                if len(code) >= fields.size:
                    fields = _Field(2 * len(code))
                second = fields.hashes(code, gram)
                for h, at in zip(hs.tolist(), ats.tolist(), strict=True):
                    for c, v in zip(cols, (d, at, h, int(second[at].view(np.int64)), t[max(0, at - reach) : at][::-1], t[at + gram : at + least]), strict=True):
                        c.append(v)
            yield pd.DataFrame(dict(zip(("doc", "at", "h", "h2", "left", "right"), cols, strict=True)))

    return _with_texts(places, docs, doc, text).mapInPandas(work, f"doc {dict(docs.dtypes)[doc]}, at int, h long, h2 long, left string, right string")


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1  # the first lo characters are equal, not all of hi + 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def compare_places(few: DataFrame, *, least: int, gram: int) -> DataFrame:
    """Spans of places of equal windows (at most ``SMALL`` a window): ``d``, ``o`` (documents), ``start``, ``stop`` (in d); a row a
    place and partner. Rows of one window lie side by side, so a batch is read once and no window is a task of its own."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            for i, (_, d, at, left, right) in enumerate(group):
                for _, e, at2, left2, right2 in group[i + 1 :]:
                    if d != e:
                        lo, hi = _common(left, left2), _common(right, right2)
                        if lo + gram + hi >= least:
                            out.append((d, e, at - lo, at + gram + hi))
                            out.append((e, d, at2 - lo, at2 + gram + hi))
            group.clear()

        columns = ["d", "o", "start", "stop"]
        for b in batches:
            for h, h2, d, at, left, right in zip(b["h"], b["h2"], b["doc"], b["at"], b["left"], b["right"], strict=True):
                if group and group[0][0] != (h, h2):
                    close()
                group.append(((h, h2), d, at, left, right))
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        close()
        yield pd.DataFrame(out, columns=columns)

    kind = dict(few.dtypes)["doc"]
    side_by_side = few.select("h", "h2", "doc", "at", "left", "right").repartition("h", "h2").sortWithinPartitions("h", "h2", "doc", "at")
    return side_by_side.mapInPandas(work, f"d {kind}, o {kind}, start int, stop int")


def windows_around(places: DataFrame, docs: DataFrame, doc: str, text: str, *, least: int, gram: int) -> DataFrame:
    """Every window of ``least`` characters that contains one of the places: ``doc``, ``at``, ``h1``, ``h2`` (its hashes), ``prev``
    (hash of the window a character before; NULL at the start of a text), ``first`` (the document's first such window).

    ``places``: doc, h, at. The windows of a document are at most its characters."""
    reach = least - gram

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, fields = _Powers(1 << 14), _Field(1 << 14)
        for b in batches:
            out = []
            for d, t, ats in zip(b["doc"], b["t"], b["ats"], strict=True):
                code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                if len(code) < least:
                    continue
                if len(code) >= fields.size:
                    powers, fields = _Powers(2 * len(code)), _Field(2 * len(code))
                h = _window_hashes(code, least, powers)
                want = np.zeros(len(h) + 1, np.int64)
                ats = np.asarray(ats)
                np.add.at(want, np.clip(ats - reach, 0, len(h)), 1)
                np.add.at(want, np.clip(ats + 1, 0, len(h)), -1)
                at = np.flatnonzero(np.cumsum(want[:-1]) > 0)
                if not len(at):
                    continue
                lo = int(at[0])
                second = fields.hashes(code[lo : int(at[-1]) + least], least)[at - lo]
                first = np.zeros(len(at), bool)
                first[np.unique(h[at], return_index=True)[1]] = True
                out.append(pd.DataFrame({"doc": d, "at": at, "h1": h[at].view(np.int64), "h2": second.view(np.int64), "prev": pd.array(h[np.maximum(at - 1, 0)].view(np.int64), dtype="Int64"), "first": first}))
                if at[0] == 0:
                    out[-1].loc[0, "prev"] = pd.NA
            if out:
                yield pd.concat(out)

    return _with_texts(places, docs, doc, text).mapInPandas(work, f"doc {dict(docs.dtypes)[doc]}, at int, h1 long, h2 long, prev long, first boolean")


class SpanIndex:
    """Log-structured index of window fingerprints over documents (id, text). ``least``: characters of a span.

    ``append`` adds a batch and returns the places of windows that it shares within itself or with batches before (those of the
    earlier documents too). Runs are Parquet in the cluster's shared folder, bucketed and sorted by hash; a new run is joined
    with each of them by itself, so no join shuffles the history."""

    def __init__(self, spark: SparkSession, doc: str, text: str, *, least: int = 400, gram: int = 300, buckets: int | None = None, max_runs: int = 2) -> None:
        self.spark, self.doc, self.text, self.least, self.gram, self.max_runs = spark, doc, text, least, gram, max_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, str]] = []
        self.compactions = 0

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name, path = f"run_{uuid.uuid4().hex}", staged_path(self.spark, "run")
        df.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h", "doc").option("path", path).format("parquet").saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        drop_path(self.spark, run[1])

    def close(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.runs = []

    def compact(self) -> None:
        """Merge all runs into one; the old runs stay until the new one is written."""
        if len(self.runs) > 1:
            merged = self.spark.table(self.runs[0][0])
            for name, _ in self.runs[1:]:
                merged = merged.unionByName(self.spark.table(name))
            new = self._write(merged)
            for run in self.runs:
                self._drop(run)
            self.runs = [new]
            self.compactions += 1

    def shared_places(self, new: DataFrame, olds: list[DataFrame]) -> DataFrame:
        """(doc, h, at) of windows whose hash is in two documents of ``new``, or in ``new`` and one of ``olds`` (both sides)."""
        merge = lambda d: d.hint("merge")  # noqa: E731  bucketed and sorted runs: neither side is shuffled or broadcast
        twice = new.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h")
        out = new.join(merge(twice), "h", "left_semi").select("doc", "h", "at")
        for old in olds:
            out = out.unionByName(new.join(merge(old.select("h")), "h", "left_semi").select("doc", "h", "at"))
            out = out.unionByName(old.join(merge(new.select("h")), "h", "left_semi").select("doc", "h", "at"))
        return out

    def append(self, batch: DataFrame) -> DataFrame:
        """Index a batch of documents; the places it shares with itself and the history. Ids must be new and unique."""
        new = self._write(fingerprints(batch, self.doc, self.text, least=self.least, gram=self.gram))
        found = stage(self.shared_places(self.spark.table(new[0]), [self.spark.table(name) for name, _ in self.runs]), "places")
        self.runs.append(new)
        if len(self.runs) > self.max_runs:
            self.compact()
        return found


def copy_classes(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Texts that occur more than once: ``doc``, ``rep`` (the smallest id with the same text, by SHA-256). Documents whose text
    is null or their own alone have no row; they are their own representatives."""
    own = stage(docs.where(f"{doc} is not null and {text} is not null").select(F.col(doc).alias("doc"), F.unhex(F.sha2(text, 256)).alias("key")), "copies")
    reps = stage(own.groupBy("key").agg(F.min("doc").alias("rep"), F.max("doc").alias("last")).where("rep < last").select("key", "rep"), "reps")
    return stage(own.join(reps, "key").select("doc", "rep"), "classes")


def shared_spans(docs: DataFrame, doc: str, text: str, arrived: str, *, least: int = 400, gram: int = 300, batches: int = 4, max_runs: int = 2) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """What different texts share: spans (d, o, start, stop), windows (None if no window is in more than ``SMALL`` places) and
    the copy classes (doc, rep). For ``document_pairs`` and ``share_of_documents``.

    Documents here are representatives (smallest ids) of classes of equal texts: copies are not compared with each other.
    They come in ``batches`` of about equal size by ``arrived`` (nulls first), as they would to a growing index; the result
    doesn't depend on the batches. Windows: (doc, at, h1, h2, prev, first, n_docs, mixed); ``n_docs``: documents that hold the
    window; ``mixed``: they don't all hold the window before it as well, so a shared stretch begins here. Texts that are
    null, empty or shorter than ``least`` share nothing."""
    spark = docs.sparkSession
    classes = copy_classes(docs, doc, text)
    copies = classes.where("doc <> rep").select(F.col("doc").alias(doc))
    copies = F.broadcast(copies) if copies.count() <= MAX_BROADCAST_IDS else copies
    when = F.coalesce(F.unix_micros(F.col(arrived).cast("timestamp_ltz")), F.lit(0))
    size = docs.agg(F.percentile_approx(when, [i / batches for i in range(1, batches)] or [0.5], 1000).alias("q"), F.sum(F.length(text)).alias("chars")).first()
    edges = sorted(set(size["q"] or [])) if batches > 1 else []
    # a run's bucket has some 64 MB of fingerprints: 2 of least - gram + 1 windows, 20 bytes each
    buckets = max(spark.sparkContext.defaultParallelism, -(-int((size["chars"] or 0) * 40 / (least - gram + 1)) // (64 << 20)))
    index, found = SpanIndex(spark, doc, text, least=least, gram=gram, buckets=buckets, max_runs=max_runs), None
    try:
        for i in range(len(edges) + 1):
            part = docs
            if i > 0:
                part = part.where(when > edges[i - 1])
            if i < len(edges):
                part = part.where(when <= edges[i])
            got = index.append(part.select(doc, text).join(copies, doc, "left_anti"))
            found = got if found is None else found.unionByName(got)
    finally:
        index.close()
    places = stage(found.distinct(), "places")
    hot = stage(places.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("h"), "hot")
    if hot.isEmpty():
        many = None
    else:
        places, many = places.join(hot, "h", "left_anti"), places.join(hot, "h", "left_semi").select("doc", "h", "at")
    spans = compare_places(contexts(places, docs, doc, text, least=least, gram=gram), least=least, gram=gram)
    spans = stage(spans.groupBy("d", "o", "start").agg(F.max("stop").alias("stop")), "spans")
    return spans, None if many is None else _window_groups(windows_around(many, docs, doc, text, least=least, gram=gram)), classes


def _window_groups(windows: DataFrame) -> DataFrame:
    """The windows that two or more documents hold, with ``n_docs`` and ``mixed``."""
    w = stage(windows, "windows")
    h = w.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.when(F.col("first"), 1)).alias("n_docs"), (F.min("prev").isNull() | (F.min("prev") < F.max("prev")) | (F.count("prev") < F.count("*"))).alias("mixed"))
    h = stage(h.where("lo < hi").drop("lo", "hi"), "hashes")
    return stage(w.join(h, ["h1", "h2"]), "shared")


def shared_pairs(windows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of documents that share a window. A pair is formed where a stretch that the two share begins: there
    the windows before differ. A window in very many documents is joined in blocks of ``HOT`` of them."""
    w = windows.where("mixed").groupBy("h1", "h2", "prev", "doc").agg(F.max("n_docs").alias("n"))
    w = w.withColumn("blocks", F.ceil(F.col("n") / HOT).cast("int"))
    a = w.select("h1", "h2", F.col("prev").alias("pa"), F.col("doc").alias("a"), F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"))
    b = w.select("h1", "h2", F.col("prev").alias("pb"), F.col("doc").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return a.join(b, ["h1", "h2", "block"]).where("a < b and (pa is null or pb is null or pa <> pb)").select("a", "b").distinct()


def count_links(spans: DataFrame, windows: DataFrame | None) -> DataFrame:
    """With how many other documents each shares a span: ``d``, ``n_links``; the same however the places were verified.

    Documents of the same begins of shared stretches are one kind and link to each other and to whole kinds, so documents
    around one passage form no pairs; kinds pair off at one of the windows that the same kinds hold. Spans add the partners
    that hold no window in common."""
    pairs = spans.select("d", "o").distinct()
    if windows is None:
        return pairs.groupBy("d").agg(F.count("*").alias("n_links"))
    begins = windows.where("mixed").select("doc", "h1", "h2").distinct()
    of = begins.groupBy("doc").agg(F.bit_xor("h1").alias("x"), F.bit_xor(F.xxhash64("h1", "h2")).alias("y"), F.count("*").alias("m"))
    kinds = stage(of.groupBy("x", "y", "m").agg(F.min("doc").alias("kind"), F.count("*").alias("size")), "kinds")
    of = stage(of.join(kinds, ["x", "y", "m"]).select("doc", "kind", "size"), "kind_of")
    held = stage(begins.join(kinds.select(F.col("kind").alias("doc"), "size"), "doc").select("h1", "h2", F.col("doc").alias("kind"), "size"), "held")
    sets = held.groupBy("h1", "h2").agg(F.bit_xor(F.xxhash64("kind")).alias("x"), F.bit_xor(F.xxhash64("kind", F.lit(1))).alias("y"), F.count("*").alias("n")).where("n > 1")
    one = sets.groupBy("x", "y", "n").agg(F.min(F.struct("h1", "h2")).alias("h")).select("h.*", F.ceil(F.col("n") / HOT).cast("int").alias("blocks"))
    w = held.join(one, ["h1", "h2"])
    a = w.select("h1", "h2", F.col("kind").alias("a"), F.pmod(F.xxhash64("kind"), F.col("blocks")).cast("int").alias("block"))
    b = w.select("h1", "h2", F.col("kind").alias("b"), "size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    near = stage(a.join(b, ["h1", "h2", "block"]).where("a <> b").select("a", "b", "size").distinct(), "kind_pairs")
    far = near.groupBy(F.col("a").alias("kind")).agg(F.sum("size").alias("n"))
    held_links = of.join(far, "kind", "left").select(F.col("doc").alias("d"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    side = lambda c: of.select(F.col("doc").alias(c), F.col("kind").alias(f"k{c}"))
    rest = pairs.join(side("d"), "d", "left").join(side("o"), "o", "left").where("kd is null or ko is null or kd <> ko")
    rest = rest.join(near.select(F.col("a").alias("kd"), F.col("b").alias("ko")), ["kd", "ko"], "left_anti")
    links = held_links.unionByName(rest.groupBy("d").agg(F.count("*").alias("n_links")))
    return links.groupBy("d").agg(F.sum("n_links").alias("n_links")).where("n_links > 0")


def share_of_documents(docs: DataFrame, doc: str, text: str, shared: tuple[DataFrame, DataFrame | None, DataFrame], least: int) -> DataFrame:
    """One row per document with text: ``doc``, ``rep`` (its copy class), ``n_copies``, ``n_links`` (classes that it shares a span
    with, by ``count_links``), ``shared_chars``, ``share`` (of its characters found in another document; a text with a copy is
    shared whole). ``shared``: from ``shared_spans``. No group of documents around one passage is turned into pairs, however large."""
    spans, windows, classes = shared
    parts = spans.select("d", "start", "stop")
    links = count_links(spans, windows)
    if windows is not None:
        parts = parts.unionByName(windows.select(F.col("doc").alias("d"), F.col("at").alias("start"), (F.col("at") + least).alias("stop")))
    ends = parts.groupBy("d", "start").agg(F.max("stop").alias("stop"))  # at most one a character of the text
    before = F.max("stop").over(W.partitionBy("d").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    covered = ends.withColumn("b", before).select("d", F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce("b", "start"))).alias("n")).groupBy("d").agg(F.sum("n").alias("shared"))
    size = classes.groupBy(F.col("rep").alias("r")).agg(F.count("*").alias("n_copies"))
    out = docs.where(f"{text} is not null and {doc} is not null").select(F.col(doc).alias("doc"), F.length(text).alias("chars")).join(classes, "doc", "left").withColumn("rep", F.coalesce("rep", "doc"))
    out = out.join(size, out["rep"] == size["r"], "left").join(links, out["rep"] == links["d"], "left").drop("d").join(covered, out["rep"] == covered["d"], "left")
    copies = F.coalesce("n_copies", F.lit(1))
    chars = F.when(copies > 1, F.col("chars")).otherwise(F.coalesce("shared", F.lit(0)).cast("int"))
    return out.select("doc", "rep", copies.alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), chars.alias("shared_chars"), F.when(F.col("chars") > 0, chars / F.col("chars")).otherwise(0.0).alias("share"))


def document_pairs(shared: tuple[DataFrame, DataFrame | None, DataFrame], docs: DataFrame, doc: str, text: str, least: int) -> DataFrame:
    """Every pair of documents that share a span, copies among them: (doc_id_a, doc_id_b), the smaller id first.

    ``shared``: from ``shared_spans``. Expands pairs of classes by their members, and each class of texts of ``least`` characters or
    more into its own pairs. The output has as many rows as there are such pairs; ``share_of_documents`` has one per document."""
    spans, windows, classes = shared
    pairs = spans.where("d < o").select(F.col("d").alias("a"), F.col("o").alias("b"))
    if windows is not None:
        pairs = pairs.unionByName(shared_pairs(windows))
    pairs = stage(pairs.distinct(), "pairs")
    member = lambda side: classes.select(F.col("rep").alias(side), F.col("doc").alias(f"m{side}"))
    crossed = pairs.join(member("a"), "a", "left").join(member("b"), "b", "left").select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
    long = docs.where(f"length({text}) >= {least}").select(F.col(doc).alias("doc"))
    whole = stage(classes.join(long, "doc", "left_semi"), "members")
    inside = whole.alias("l").join(whole.alias("r"), F.expr("l.rep = r.rep and l.doc < r.doc")).select(F.col("l.doc").alias("x"), F.col("r.doc").alias("y"))
    return crossed.unionByName(inside).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
