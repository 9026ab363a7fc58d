"""Collocations of two to four words, mined with stripes.

A stripe is a prefix of words with an associative counter of the words that follow it.
Four levels of stripes (prefixes of 0 to 3 words) are made in Arrow batches and merged
elementwise.  The entries are the counts of all extensions, the sum of the stripes without
a prefix is the number of words, and the greatest entry of a prefix is the subsumption
maximum of that phrase (to the right; the same counts by suffix give the left one).

* A phrase is as frequent as asked only if both phrases one word shorter are.  What the
  level before found goes to the next level as a bit table of bounded size (``FILTER``);
  its false positives only cost time, since counts are exact.
* Stripes meet by language and prefix.  The stripes without a prefix and those of prefixes
  that hold more than one of ``SHARE`` words are cut into segments by a hash of the next
  word (at most ``SHARE`` such prefixes exist), so no task merges a frequent word alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import documents, pieces, stored, table

LONGEST, LEAST, TOP = 4, 30, 2000
#: Cut and subsumption: score = floor(SCALE * a / (l + r)); a phrase goes if a longer one has 80 % of it.
SCALE, COVER = 2_000_000, 80
#: Most bits of the table of frequent phrases (16 MB), bytes of text in a chunk.
FILTER, CHUNK = 1 << 27, 1 << 23
SHARE, SEGMENTS = 2000, 256
STRIPES = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("seg", pa.int32()), ("next", pa.binary()), ("counts", pa.binary())])
ENTRIES = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("next", pa.string()), ("n", pa.int64()), ("total", pa.int64())])
#: What each byte is: 0 part of a word, 1 a blank, 2 the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of some texts (A-Z lower-cased), the piece and the text each one is in."""
    texts = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = _KIND[raw]
    inside = kind == 0
    first = np.r_[True, ~inside[:-1]] if len(raw) else np.zeros(0, bool)
    border = np.zeros(len(raw) + 1, bool)
    border[ends[:-1]] = True  # a text starts a word and a piece
    first = np.flatnonzero(inside & (first | border[:-1]))
    piece = np.cumsum((kind == 2) | border[:-1], dtype=np.int32)[first]
    where = np.cumsum(inside, dtype=np.int64)
    starts = where[first] - 1
    offsets = np.r_[starts, where[-1] if len(where) else 0].astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())])
    return packed.dictionary_encode(), piece, np.searchsorted(ends, first, "right") - 1


class Frequent:
    """A bit table of the phrases of a level, and the prefixes whose stripes are cut."""

    def __init__(self, bits: np.ndarray | None = None, wide: np.ndarray | None = None):
        self.bits, self.wide = bits, wide if wide is not None else np.zeros(0, np.uint64)
        self.shift = np.uint64(0 if bits is None else 64 - int(bits.size * 8).bit_length() + 1)

    def holds(self, grams: np.ndarray) -> np.ndarray:
        at = grams >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def gram_hashes(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """One hash per phrase: of its language and its words in order."""
    out = langs
    for w in words:
        out = _mixed(out * _MIX + w)
    return out


def stripes(texts: pa.Array, langs: pa.Array, level: int, frequent: Frequent) -> pa.RecordBatch:
    """The stripes of all prefixes of ``level`` words in some texts."""
    coded, piece, text = split_words(texts)
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    tongues = pc.fill_null(langs, "und").dictionary_encode()
    tongue = tongues.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text] if len(text) else np.zeros(0, np.int64)
    size = max(len(words), 1)
    hashed, seeds = hashes(words), hashes(tongues.dictionary)
    at = np.arange(max(len(code) - level, 0))
    at = at[piece[at] == piece[at + level]]
    if level:  # both phrases of ``level`` words must be frequent; the second is the first one of the next start
        starts = np.arange(max(len(code) - level + 1, 0))
        known = frequent.holds(gram_hashes(seeds[tongue[starts]], [hashed[code[starts + k]] for k in range(level)]))
        at = at[known[at] & known[at + 1]]
    prefix = tongue[at]
    for k in range(level):
        _, prefix = np.unique(prefix * size + code[at + k], return_inverse=True)
    pair, place, count = np.unique(prefix * size + code[at + level], return_index=True, return_counts=True)
    prefix, at = pair // size, at[place]
    following = code[at + level]
    starts = gram_hashes(seeds[tongue[at]], [hashed[code[at + k]] for k in range(level)])
    cut = np.isin(starts, frequent.wide) if level else np.ones(len(at), bool)
    seg = np.where(cut, hashed[following] >> np.uint64(56), 0).astype(np.int32) % SEGMENTS
    order = np.lexsort((seg, prefix))
    prefix, at, seg, following, count = (x[order] for x in (prefix, at, seg, following, count))
    edge = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (seg[1:] != seg[:-1])]) if len(at) else np.zeros(0, np.int64)
    offsets, head = np.r_[edge, len(at)].astype(np.int32), at[edge]
    start = [words.take(pa.array(code[head + k])) for k in range(level)]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(following))), b" ")
    counts = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets * np.int32(4)), pa.py_buffer(count.astype("<i4").tobytes())])
    return table(STRIPES, tongues.dictionary.take(pa.array(tongue[head])),
                 pc.binary_join_element_wise(*start, b" ") if level else pa.array([b""] * len(edge), pa.binary()),
                 pa.array(seg[edge], pa.int32()), joined, counts)


def merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Stripes of one language, prefix and segment arrive one after another and are added up.

    Gives the entries of at least ``least``, and for stripes without a prefix a row without a
    next word that holds the sum.  A batch is merged as arrays; its last stripe waits, added
    up, for its rest in the next one.
    """
    key, held, sums = None, pa.array([], pa.binary()), np.zeros(0, np.int64)

    def rows(langs: list, prefixes: list, group: np.ndarray, words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        keep = np.flatnonzero(n >= least)
        where = group[keep].tolist()
        whole = [g for g, p in enumerate(prefixes) if not p]
        totals = np.bincount(group, n, len(prefixes)).astype(np.int64) if whole else n
        names = words.take(pa.array(keep)).cast(pa.string()).to_pylist()
        return table(ENTRIES, [langs[g] for g in where] + [langs[g] for g in whole],
                     [prefixes[g].decode() for g in where] + [""] * len(whole), names + [None] * len(whole),
                     n[keep].tolist() + [None] * len(whole), [None] * len(keep) + [int(totals[g]) for g in whole])

    for batch in batches:
        if not batch.num_rows:
            continue
        langs, prefixes, segs = (batch.column(c) for c in ("lang", "prefix", "seg"))
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in (langs, prefixes, segs)], axis=0)
        first = np.flatnonzero(new)
        keys = list(zip(*(c.take(pa.array(first)).to_pylist() for c in (langs, prefixes, segs))))
        lists = pc.split_pattern(batch.column("next"), b" ")
        group = np.repeat(np.cumsum(new) - 1, pc.list_value_length(lists).to_numpy())
        words, n = lists.flatten(), np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i4").astype(np.int64)
        if key is not None:
            if keys[0] != key:
                keys.insert(0, key)
                group = group + 1
            words = pa.concat_arrays([held, words])
            group, n = np.r_[np.zeros(len(held), np.int64), group], np.r_[sums, n]
        coded = words.dictionary_encode()
        size = len(coded.dictionary)
        pair, at = np.unique(group * size + coded.indices.to_numpy(), return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, at, n)
        group, words = pair // size, coded.dictionary.take(pa.array(pair % size))
        last = int(np.searchsorted(group, len(keys) - 1))
        key, held, sums = keys[-1], words[last:], total[last:]
        if last:
            yield rows([k[0] for k in keys[:-1]], [k[1] for k in keys[:-1]], group[:last], words[:last], total[:last])
    if key is not None:
        yield rows([key[0]], [key[1]], np.zeros(len(held), np.int64), held, sums)


def level_counts(docs: DataFrame, level: int, frequent: Frequent, least: int) -> DataFrame:
    """``lang, prefix, next, n, total``: frequent phrases of ``level + 1`` words (and sums, at level 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", CHUNK):
            yield stripes(part.column("text"), part.column("lang"), level, frequent)

    dealt = docs.mapInArrow(run, "lang string, prefix binary, seg int, next binary, counts binary")
    key = ["lang", "prefix", "seg"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        lambda batches: merge(batches, least), "lang string, prefix string, next string, n bigint, total bigint")


def frequent_phrases(found: DataFrame, level: int, words: int, most: int = FILTER) -> Frequent:
    """The bit table of what a level found, for the next one; at most ``most`` bits and ``SHARE`` prefixes."""
    rows = found.where("next IS NOT NULL")
    size = 1 << 16
    while size < most and size < 64 * rows.count():
        size *= 2
    shift = np.uint64(64 - size.bit_length() + 1)
    schema = pa.schema([("cell", pa.int64()), ("bits", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, last = batch.column("prefix").cast(pa.binary()), batch.column("next").cast(pa.binary())
            parts = pc.split_pattern(prefix, b" ").flatten() if level else pa.array([], pa.binary())
            earlier = hashes(parts).reshape(-1, level) if level else np.zeros((batch.num_rows, 0), np.uint64)
            seeds = hashes(pc.fill_null(batch.column("lang"), ""))
            grams = gram_hashes(seeds, [*earlier.T, hashes(last)])
            at = grams >> shift
            yield table(schema, (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64),
                        grams.view(np.int64), batch.column("n"))

    marked = rows.select("lang", "prefix", "next", "n").mapInArrow(run, "cell bigint, bits bigint, gram bigint, n bigint")
    cells = marked.groupBy("cell").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    wide = marked.where(F.col("n") > max(words // SHARE, 1000)).select("gram").toArrow()["gram"].to_numpy()
    return Frequent(bits.view(np.uint8), np.unique(wide.view(np.uint64)))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 longest: int = LONGEST, cover: int = COVER) -> DataFrame:
    """All collocations: ``lang, phrase, a, l, r, n, score``.

    Texts are split at ``.,;:!?`` and line ends into pieces, and those at blanks into words
    (A-Z lower-cased); a phrase lies within a piece.  ``a`` counts a phrase, ``l`` and ``r``
    the parts of its weakest cut, ``n`` all words of the language.  Phrases of 2 to ``longest``
    words count from ``least`` on; a phrase of which a longer one holds ``cover`` percent is
    left out.

    Null and empty texts hold no word, a null language is ``und``, repeated rows count as
    often as they are there, an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    frequent, levels, totals = Frequent(), [], None
    for level in range(longest):
        found = stored(level_counts(rows, level, frequent, least), f"stripes-{level}")
        if not level:
            totals = stored(found.where("next IS NULL").groupBy("lang").agg(F.sum("total").alias("n")), "words")
            words = int(totals.agg(F.sum("n")).first()[0] or 0)
        phrase = F.col("next") if not level else F.concat_ws(" ", "prefix", "next")
        levels.append(found.where("next IS NOT NULL").select(
            "lang", F.lit(level + 1).alias("size"), phrase.alias("phrase"), "prefix", F.col("n").alias("a")))
        if level + 1 < longest:
            frequent = frequent_phrases(found, level, words)
    counted = levels[0]
    for more in levels[1:]:
        counted = counted.unionByName(more)
    counts = counted.select("lang", "phrase", "a")
    wide = counted.where("size > 1")
    # Greatest count of a phrase one word longer, on either side: what still longer ones cannot exceed.
    rest = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    longer = wide.select("lang", F.explode(F.array("prefix", rest)).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("most"))
    kept = wide.join(longer, ["lang", "phrase"], "left").where(
        f"most IS NULL OR CAST(most AS DECIMAL(30,0)) * 100 < CAST(a AS DECIMAL(30,0)) * {cover}")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"), "size").select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("last"))
    first, last = (counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(n)) for side, n in (("first", "l"), ("last", "r")))
    scored = cuts.join(first, ["lang", "first"]).join(last, ["lang", "last"]).select(
        "lang", "phrase", "a", F.expr(f"struct((CAST({SCALE} AS DECIMAL(18,0)) * a) div (CAST(l AS DECIMAL(20,0)) + r) AS score, k, l, r)").alias("cut"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    return weakest.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


def top_collocations(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language, with their rank: by score, count, then text."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op12_phrases": lambda s, d: top_collocations(collocations(documents(s, d)))}

ORACLE = {"op12_phrases": r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda w: w <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[.,;:!?\x0A-\x0D]')) AS part
      FROM documents))
  WHERE len(words) > 0),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase, count(*) AS a
  FROM starts, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE i + size - 1 <= len(words) GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE a >= 30),
inner_parts AS (
  SELECT o.lang, o.size AS longer, o.a AS most, array_to_string(o.w[s.i : s.i + s.m - 1], ' ') AS phrase
  FROM often o, (SELECT i, m FROM (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m)) s
  WHERE s.m < o.size AND s.i + s.m - 1 <= o.size),
held AS (SELECT lang, phrase, max(most) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT o.* FROM often o LEFT JOIN held h ON o.lang = h.lang AND o.phrase = h.phrase
         WHERE o.size > 1 AND (h.most IS NULL OR 100 * h.most::HUGEINT < 80 * o.a::HUGEINT)),
cuts AS (
  SELECT k.lang, k.phrase, k.a, c.k, f.a AS l, r.a AS r, (2000000::HUGEINT * k.a) // (f.a + r.a) AS score
  FROM kept k, (SELECT unnest([1, 2, 3]) AS k) c, often f, often r
  WHERE c.k < k.size AND f.lang = k.lang AND f.phrase = array_to_string(k.w[1 : c.k], ' ')
    AND r.lang = k.lang AND r.phrase = array_to_string(k.w[c.k + 1 : k.size], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score::BIGINT AS score
FROM best b JOIN totals t ON b.lang = t.lang
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) <= 2000"""}
