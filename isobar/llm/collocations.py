"""Phrase collocation mining by stripes.

The stripe of a word is an associative counter of what follows it: the empty continuation holds the word's own total, a continuation of
one word the extension by that word, one of two words the extension of that prefix in turn. Tasks build the stripes of a window of words at
a time and send them packed, one row for each first word; elementwise sums merge them on the other side of the shuffle. Prefix totals,
extensions and the largest extension of a phrase (subsumption) are then read from the one merged counter.

A word that holds a noticeable share of all words has its stripe dealt in slots by hash of the continuation. Elements are merged by Spark's
aggregation, which spills, so no stripe has to fit in memory.

Cases: null texts are empty; a null language counts as `und`; repeated rows count each time; an empty table gives no rows; of texts
of any length every word counts; no other column is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.llm.common import Scratch, sliced, small

#: Words counted together before they are sent; their number bounds a task's memory.
WINDOW = 1 << 20
#: A word is noted if a window has it so often; the sum of these notes tells which stripes are dealt in slots.
NOTED = 16
#: At most so many words can have slots: those with one word in so many.
SHARE = 1 << 16
#: Words whose stripes an aggregation task merges, about.
TASK_WORDS = 1 << 20
#: Groups in which a language's phrases are ranked before the last ranking.
GROUPS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BITS = 21
_SPACE, _END = (pa.scalar(x, pa.large_string()) for x in (" ", "\n"))


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts with a line feed after each piece, and the number of these tokens in each text."""
    lower = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    pieces = pc.binary_join_element_wise(pc.replace_substring_regex(lower, r"[.,;:!?\n\x0b\x0c\r]+", " \n "), _END, _SPACE)
    words = pc.split_pattern_regex(pieces, r"[ \t]+")
    flat = words.flatten()
    full = pc.not_equal(flat, pa.scalar("", pa.large_string()))
    ends = words.offsets.to_numpy() - words.offsets[0].as_py()
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), np.diff(kept[ends])


def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, int]]:
    """Windows of tokens: (token, language of each, how many of them may be first words); two more tokens follow those."""
    held: list[tuple[pa.Array, pa.Array]] = []
    n = 0

    def flush() -> Iterator[tuple[pa.Array, pa.Array, int]]:
        flat, lang = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
        for at in range(0, len(flat), WINDOW):
            yield flat.slice(at, WINDOW + 2), lang.slice(at, WINDOW + 2), min(WINDOW, len(flat) - at)

    for batch in sliced(batches):
        flat, sizes = tokens(batch.column(1))
        held.append((flat, batch.column(0).cast(pa.large_string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))))
        n += len(flat)
        if n >= WINDOW:
            yield from flush()
            held, n = [], 0
    if n:
        yield from flush()


def _codes(flat: pa.Array, lang: pa.Array, firsts: int) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(distinct tokens, token ids with two ends more, id of the end, distinct languages, language ids of first words)."""
    words, langs = flat.dictionary_encode(), lang.slice(0, firsts).dictionary_encode()
    end = pc.index(words.dictionary, _END).as_py()
    ids = words.indices.to_numpy().astype(np.int64)
    return words.dictionary, ids, end, langs.dictionary, langs.indices.to_numpy().astype(np.int64)


def noted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By window: each language's number of words (word null), and the words that stand at least NOTED times."""
    for flat, lang, firsts in windows(batches):
        words, ids, end, langs, where = _codes(flat, lang, firsts)
        real = ids[:firsts] != end
        code, n = np.unique((where << _BITS | ids[:firsts])[real], return_counts=True)
        often = n >= NOTED
        total = np.bincount(where[real], minlength=len(langs))
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([langs.cast(pa.string()), langs.take(pa.array(code[often] >> _BITS)).cast(pa.string())]),
                pa.concat_arrays([pa.nulls(len(langs), pa.string()), words.take(pa.array(code[often] & (1 << _BITS) - 1)).cast(pa.string())]),
                pa.array(np.concatenate([total, n[often]]), pa.int64()),
            ],
            names=["lang", "word", "n"],
        )


def stripes(batches: Iterable[pa.RecordBatch], slots: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    """By window: rows (lang, first, slot, stripe), the stripe's elements as lines `count continuation`."""
    for flat, lang, firsts in windows(batches):
        words, ids, end, langs, where = _codes(flat, lang, firsts)
        ids = np.concatenate([ids, [end, end]]) if len(ids) < firsts + 2 else ids
        a, b, c = ids[:firsts], ids[1 : firsts + 1], ids[2 : firsts + 2]
        heads, head = np.unique(where << _BITS | a, return_inverse=True)
        none = len(words)  # an id for "no word"
        real = a != end
        two, three = real & (b != end), real & (b != end) & (c != end)
        low = lambda on, x, y: head[on] << 2 * _BITS | x << _BITS | y
        code = np.concatenate([low(real, none, none), low(two, b[two], none), low(three, b[three], c[three])])
        code, n = np.unique(code, return_counts=True)
        h, b, c = code >> 2 * _BITS, code >> _BITS & (1 << _BITS) - 1, code & (1 << _BITS) - 1
        spelt = pa.concat_arrays([words, pa.array([""], words.type)])
        first = words.take(pa.array(heads & (1 << _BITS) - 1))
        of_lang = langs.take(pa.array(heads >> _BITS))
        many = np.array([slots.get(k, 1) for k in zip(of_lang.to_pylist(), first.to_pylist(), strict=True)]) if slots else np.ones(len(heads), int)
        slot = np.zeros(len(code), np.int64)
        split = np.flatnonzero(many[h] > 1)
        if len(split):
            crc = np.array([zlib.crc32(w.encode()) for w in spelt.to_pylist()])
            slot[split] = (crc[b[split]] * 31 + crc[c[split]]) % 2_147_483_647 % many[h[split]]
            order = np.lexsort((slot, h))
            h, b, c, n, slot = (x[order] for x in (h, b, c, n, slot))
        tail = pc.binary_join_element_wise(spelt.take(pa.array(b)), spelt.take(pa.array(c)), _SPACE)
        lines = pc.binary_join_element_wise(pa.array(n).cast(pa.large_string()), pc.ascii_rtrim(tail, characters=" "), _SPACE)
        starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (slot[1:] != slot[:-1])])
        own = pa.array(h[starts])
        packed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.r_[starts, len(h)], pa.int64()), lines), _END)
        out = [of_lang.take(own), first.take(own), pa.array(slot[starts], pa.int32()), packed]
        for at in range(0, len(starts), 4096):
            rows = [x.slice(at, 4096) for x in out]
            yield pa.RecordBatch.from_arrays([x if x.type == pa.int32() else x.cast(pa.string()) for x in rows], names=["lang", "first", "slot", "stripe"])


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, n), all words of each language, and (lang, phrase, words, f), the phrases of one to three words that stand `least` times or more."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    notes = rows.mapInArrow(noted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    notes = scratch.keep(notes, "notes")
    totals = notes.where("word is null").select("lang", "n").where("n > 0")
    n = totals.agg(F.sum("n")).first()[0] or 0
    # At most SHARE words can have one word in SHARE, and these are known to the driver.
    hot = notes.where(F.col("word").isNotNull() & (F.col("n") >= max(n // SHARE, TASK_WORDS // 16))).collect()
    slots = {(r["lang"], r["word"]): -(-r["n"] * 16 // TASK_WORDS) for r in hot}
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_WORDS)
    packed = rows.mapInArrow(lambda batches: stripes(batches, slots), "lang string, first string, slot int, stripe string")
    line = packed.repartition(parts, "lang", "first", "slot").select("lang", "first", "slot", F.explode(F.split("stripe", "\n")).alias("line"))
    element = line.select("lang", "first", "slot", F.substring_index("line", " ", 1).cast("long").alias("n"), F.expr("substr(line, locate(' ', line) + 1)").alias("rest"))
    # The rows already lie together by (lang, first, slot), so this sum shuffles nothing.
    merged = element.groupBy("lang", "first", "slot", "rest").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    phrase = F.rtrim(F.concat_ws(" ", "first", "rest"))
    words = F.when(F.col("rest") == "", 1).when(F.locate(" ", "rest") == 0, 2).otherwise(3)
    return totals, scratch.keep(merged.select("lang", phrase.alias("phrase"), words.alias("words"), "f"), "phrases")


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's `top` phrases of two or three words by score, with columns lang, rank, phrase, a, l, r, n, score.

    A phrase counts if it stands at least `least` times, and not if a longer one that counts holds it in at least `covered` of 100 places.
    """
    totals, f = phrase_counts(docs, least, text_col, lang_col)
    found = f.where("words > 1").withColumn("w", F.split("phrase", " "))
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    inside = found.where("words = 3").select("lang", F.explode(F.array(join(1, 2), join(2, 2))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    left = found.join(inside, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < covered * F.col("f")))
    cuts = left.select("lang", "phrase", F.col("f").alias("a"), "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # Products of counts below 10^16 are exact in 38 digits.
    big: Column = F.col("a").cast("decimal(16,0)") * F.col("a").cast("decimal(16,0)")
    score = F.expr("(1000000 * a2) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("a2", big).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*")
    # A language's phrases are ranked in GROUPS groups first, so that its last task reads at most `top` of each.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    ranked = worst.withColumn("rank", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 10, covered: int = 50, top: int = 2000) -> str:
    return rf"""
    WITH docs AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
    piece AS (SELECT lang, doc, unnest(pieces) AS piece FROM docs),
    lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM piece),
    word AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
    gram AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM word, (VALUES (1), (2), (3)) AS t(k) WHERE i + k - 1 <= len(w)),
    f AS (SELECT lang, k AS words, phrase, count(*) AS f FROM gram GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY ALL),
    found AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= {least}),
    inside AS (SELECT lang, phrase, max(f) AS longest FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM found WHERE words = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM found WHERE words = 3) GROUP BY ALL),
    kept AS (SELECT found.* FROM found LEFT JOIN inside USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < {covered} * f),
    cuts AS (SELECT lang, phrase, f AS a, words, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:words], ' ') AS tail FROM kept, (VALUES (1), (2)) AS t(k) WHERE k < words),
    scored AS (SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, k, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
               FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head AND x.words = k JOIN f y ON y.lang = cuts.lang AND y.phrase = tail AND y.words = cuts.words - k),
    worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
