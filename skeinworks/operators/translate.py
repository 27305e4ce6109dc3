"""Translation around a model: targets, pieces, reassembly, and checks of what came back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.messages import characters, transcript_hash, turn_labels
from skeinworks.functions.text import batch_numbers, is_english_label, soft_pieces
from skeinworks.operators.audit import wanted
from skeinworks.operators.inference import translate_batches
from skeinworks.operators.review import checked, require_empty

#: Characters a translation may always have, and how many times its source beyond; a fixed value each.
MIN_LIMIT, MAX_EXPANSION = 240, 7
#: Answers that echo the request instead of translating; fixed values.
ECHO_HEAD = r'^\s*\{\s*"(?:index|turn|source)"'
ECHO_NOTE = r'(?i)^\s*translations"\s*:\s*\[|note:\s*the\s+(?:first|second|third|input)|not a string to be translated'
#: Short English that needs no detector; fixed values.
SHORT_ENGLISH = ("a", "an", "and", "are", "hello", "hi", "i", "is", "it", "no", "ok", "okay", "the", "to", "yes", "you")


def surely_english(text: Column, probability: Column | None = None) -> Column:
    """No letters: no.  Under 20 letters: only short English words, or two words and a probability of 0.99.  Else a probability of 0.9.

    ``probability`` is that of English by a detector of the caller's; without it only the word list decides.
    """
    letters = F.regexp_count(text, F.lit("[A-Za-z]"))
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), 1)
    listed = (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*SHORT_ENGLISH))
    p = F.lit(0.0) if probability is None else F.coalesce(probability, F.lit(0.0))
    return F.when(letters == 0, False).when(letters < 20, listed | ((F.size(words) >= 2) & (p >= 0.99))).otherwise(p >= 0.9)


def targets(corpus: DataFrame, levels: DataFrame, *, wanted: tuple[int, ...] = (5, 4, 3), key: str = "id") -> DataFrame:
    """Conversations of the wanted levels that aren't labelled English, with ``place`` by level and length, both descending, then id.

    The reviewed levels are a few rows beside the corpus; Spark broadcasts them if they are small.
    """
    chosen = levels.where(F.col("level").isin(*wanted)).select(key, "level")
    rows = corpus.where(~is_english_label(F.col("language"))).join(chosen, key).withColumn("characters", characters(F.col("messages")))
    # Ranked by counts of each level and length, and inside each, so no task holds all
    sized = rows.withColumn("__n", F.coalesce("characters", F.lit(-1).cast("long")))
    before = F.sum("n").over(Window.orderBy(F.desc("level"), F.desc("__n")).rowsBetween(Window.unboundedPreceding, -1))
    lengths = sized.groupBy("level", "__n").agg(F.count(F.lit(1)).alias("n")).select("level", "__n", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("level", "__n").orderBy(key))
    placed = sized.withColumn("__inside", inside).join(lengths, ["level", "__n"]).withColumn("place", F.col("__before") + F.col("__inside"))
    return placed.select(*rows.columns, "place")


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` targets; 0 gives none, null all, a negative one is an error."""
    if limit is not None and limit < 0:
        raise ValueError("the limit is negative")
    return rows if limit is None else rows.where(F.col("place") <= limit)


def pieces(rows: DataFrame, *, key: str = "id", limit: int = 3_000, passthrough: Column | None = None) -> DataFrame:
    """key, message_index, part_index, parts, turn, text, passthrough: every message in pieces; empty and English ones pass through."""
    paired = F.transform(F.arrays_zip(turn_labels(F.col("messages")).alias("turn"), F.col("messages").alias("m")), lambda z: F.struct(z["turn"].alias("turn"), z["m"]["content"].alias("content")))
    said = rows.select(key, F.posexplode(paired).alias("message_index", "m")).select(key, "message_index", F.col("m.turn").alias("turn"), F.coalesce("m.content", F.lit("")).alias("content"))
    english = surely_english(F.col("content")) if passthrough is None else passthrough
    said = said.withColumn("passthrough", (F.col("content") == "") | english).withColumn("pieces", soft_pieces(F.col("content"), limit))
    return said.select(key, "message_index", F.posexplode("pieces").alias("part_index", "text"), F.size("pieces").alias("parts"), "turn", "passthrough")


def batched(piece_rows: DataFrame, *, key: str = "id", max_items: int = 8, max_characters: int = 4_000) -> DataFrame:
    """The pieces to translate with the number of their batch inside the conversation."""
    place = F.struct("message_index", "part_index", "text")
    found = piece_rows.where(~F.col("passthrough")).groupBy(key).agg(F.array_sort(F.collect_list(place)).alias("p"))
    numbers = batch_numbers(F.transform("p", lambda x: F.length(x["text"])), max_items=max_items, max_characters=max_characters)
    return found.select(key, F.explode(F.arrays_zip(F.col("p"), numbers.alias("batch"))).alias("z")).select(key, "z.p.message_index", "z.p.part_index", "z.p.text", "z.batch")


def reassemble(piece_rows: DataFrame, translated: DataFrame, *, key: str = "id") -> DataFrame:
    """key, translations: the translated pieces (key, message_index, part_index, translation) put together in order; pieces that pass through are their own."""
    both = piece_rows.join(translated, [key, "message_index", "part_index"], "left")
    text = F.when(F.col("passthrough"), F.col("text")).otherwise(F.col("translation"))
    parts = both.groupBy(key, "message_index").agg(F.array_sort(F.collect_list(F.struct("part_index", text.alias("text")))).alias("p"))
    joined = parts.select(key, "message_index", F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"))
    ordered = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("message_index", "text"))).alias("m"))
    return ordered.select(key, F.transform("m", lambda x: x["text"]).alias("translations"))


def echoes(translation: Column) -> Column:
    return translation.rlike(ECHO_HEAD) | (translation.contains('"turn"') & translation.contains('"source"')) | translation.rlike(ECHO_NOTE)


def _checked(conversations: DataFrame, records: DataFrame, key: str, *more: str) -> tuple[DataFrame, Column, Column]:
    """Records with their messages, the pairs (source, translation) of their turns, and a fault of the whole: ``hash`` or ``count``."""
    rows = conversations.select(key, "messages").join(records.select(key, "source_sha256", "translations", *more), key)
    translations = F.coalesce("translations", F.array().cast("array<string>"))
    pairs = F.zip_with("messages", translations, lambda m, t: F.struct(m["content"].alias("s"), F.coalesce(t, F.lit("")).alias("t")))
    return rows, pairs, F.when(~F.col("source_sha256").eqNullSafe(transcript_hash(F.col("messages"))), "hash").when(F.size(translations) != F.size("messages"), "count")


def faults(conversations: DataFrame, records: DataFrame, *, key: str = "id") -> DataFrame:
    """key, fault for every record of a known conversation: ``hash``, ``count``, ``unfaithful`` (too long, or an echo; exempt are empty and English turns), or null."""
    rows, pairs, fault = _checked(conversations, records, key)
    bad = F.exists(pairs, lambda p: (p["s"] != "") & ~surely_english(p["s"]) & ((F.length(p["t"]) > F.greatest(F.lit(MIN_LIMIT), MAX_EXPANSION * F.length(p["s"]))) | echoes(p["t"])))
    return rows.select(key, fault.when(bad, "unfaithful").alias("fault"))


def unfit(conversations: DataFrame, records: DataFrame, *, method: str, key: str = "id") -> DataFrame:
    """key, fault for records that are to be printed: ``hash``, ``count``, ``empty`` (a turn with text has no translation), ``method`` (another than asked for), or null."""
    rows, pairs, fault = _checked(conversations, records, key, "translation_method")
    empty = F.exists(pairs, lambda p: (p["s"] != "") & (p["t"] == ""))
    other = ~F.lower(F.coalesce("translation_method", F.lit(""))).contains(method.lower())
    return rows.select(key, fault.when(empty, "empty").when(other, "method").alias("fault"))


def repair_passthrough(conversations: DataFrame, records: DataFrame, *, key: str = "id") -> DataFrame:
    """Cached records with the turns that need no translation set back to their source."""
    rows = records.join(conversations.select(key, "messages"), key)
    fixed = F.zip_with("messages", "translations", lambda m, t: F.when((m["content"] == "") | surely_english(m["content"]), m["content"]).otherwise(t))
    return rows.withColumn("translations", F.when(F.size("messages") == F.size("translations"), fixed).otherwise(F.col("translations"))).drop("messages")


def unavailable(requested: DataFrame, available: DataFrame, *, key: str = "id") -> DataFrame:
    """Requested ids without a record."""
    return requested.select(key).distinct().join(available.select(key), key, "left_anti")


def appendix(reviews: DataFrame, conversations: DataFrame, translations: DataFrame, *, key: str = "id") -> DataFrame:
    """Reviewed conversations with their translations, null where none is needed.

    A review without its conversation, or one in another language without a translation, is an error.
    """
    talks = wanted(conversations, reviews, key=key)
    both = reviews.join(talks, key).join(translations.select(key, "translations"), key, "left")
    lacking = ~is_english_label(F.col("language")) & F.col("translations").isNull()
    return checked(both, lacking, F.concat(F.lit("conversation without a translation: "), F.col(key).cast("string")))


def run(
    records: DataFrame, cache: DataFrame, call: Callable[[list[str]], list[str]], ledger: str, *, key: str = "id", limit: int | None = None, method: str | None = None, max_items: int = 8, max_characters: int = 4_000, attempts: int = 3, pause: float = 1.0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A translation run: (key, status of all records; new and repaired cache records; failures).

    ``records`` are targets with ``messages``, ``language`` and ``place``; ``cache`` holds key,
    source_sha256, translation_method and translations.  Cached turns that need no translation
    are set back, faulty records are dropped, and what is then missing, up to ``limit`` by place, is
    translated in batches of pieces.  A conversation with a failed batch is a failure and stores nothing.
    Answers are written to the new folder ``ledger`` before anything is built from them, so the model is asked once.
    """
    require_empty(records.where(is_english_label(F.col("language"))).select(key), "records that need no translation")
    talks = records.select(key, "messages")
    mine = cache.join(talks.select(key), key, "left_semi")
    repaired = repair_passthrough(talks, mine, key=key)
    sound = repaired.join(faults(talks, repaired, key=key).where("fault IS NULL").select(key), key, "left_semi")
    waiting = records.join(sound.select(key), key, "left_anti")
    if limit is not None:
        if limit < 0:
            raise ValueError("the limit is negative")
        waiting = waiting.orderBy("place").limit(limit)
    parts = pieces(waiting, key=key)
    answers = translate_batches(batched(parts, key=key, max_items=max_items, max_characters=max_characters), call, key=key, attempts=attempts, pause=pause)
    answers.write.parquet(ledger)
    answers = records.sparkSession.read.schema(answers.schema).parquet(ledger)
    failed = answers.where("error IS NOT NULL").groupBy(key).agg(F.min("error").alias("error"))
    done = reassemble(parts, answers, key=key).join(failed, key, "left_anti").join(talks, key)
    fresh = done.select(key, transcript_hash(F.col("messages")).alias("source_sha256"), F.lit(method).cast("string").alias("translation_method"), "translations")
    old = sound.select(key, "source_sha256", "translation_method", "translations")
    state = F.when(F.col("__old"), "complete").when(F.col("error").isNotNull(), "failed").when(F.col("__new"), "translated").otherwise("pending")
    status = records.select(key).join(old.select(key, F.lit(True).alias("__old")), key, "left").join(fresh.select(key, F.lit(True).alias("__new")), key, "left").join(failed, key, "left").select(key, state.alias("status"))
    return status, old.unionByName(fresh), failed


def english_probability(text: Column, detector: Callable[[list[str]], list[float]]) -> Column:
    """The caller's detector on Arrow batches, for ``surely_english`` and ``pieces``; a null text has none."""

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([None] * len(texts), dtype="float64")
        out[known.to_numpy()] = detector(texts[known].tolist())
        return out

    return probability(text)
