"""Line dedup with a tree of log templates.

A line is parsed by a tree of fixed depth: the number of its tokens, then its leading tokens;
a token with a digit is a variable field.  A leaf generalises over its distinct lines: a further
position keeps the token that most of them have, and is variable where none has most.  Lines
that agree with all that the leaf's template keeps are of that template.  The others are dealt to clusters by their token at
the position where these lines have the fewest different ones, which tells templates apart rather than what fills their
fields; each cluster generalises likewise, and so on for a fixed depth.  Lines of no template stand for
themselves.  Lines and templates found in enough documents recur; they are dropped, but for
the first document that has them.

All work is DataFrame expressions over hashes of lines.  A frequent line is one row for each
document before it meets the others; tokens are compared, by position, only in leaves that could
recur, one row for each distinct line; and only documents that lose lines are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.common import written

#: Leading tokens in the tree.
LEADING = 3
#: Documents of a recurring line or template, at least; of a line of ``LONG`` tokens or more, as it is but for its digits.
LEAST_DOCS, LONG, LEAST_DOCS_LONG = 5, 12, 2
#: Tokens that a template keeps, of a hundred of its lines', at least.
LEAST_KEPT = 70
#: Times that the lines of a leaf which fit no template are dealt to clusters.
SPLITS = 3
VARIABLE = "<*>"
#: Bits of the filter that tells lines of busy leaves from most others, and those in a row of Spark's bitmaps: half a megabyte in all, whatever the table.
FILTER_BITS, ROW_BITS = 1 << 22, 1 << 15


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` (with ``line``) as ``masked``, tokens by single spaces, with their number ``n``, the line's ``chars``, and hashes of line (``own``), its leading tokens (``lead``) and these and ``n`` (``leaf``); lines without a constant token are left out.

    Tokens are counted and cut at single spaces, so only lines with digits or other white space are rewritten
    first; a variable field is looked for at the start of a token alone, so long tokens take linear time.
    """
    line = F.col("line")
    odd = line.rlike(r"[0-9\x09-\x0D]") | line.contains("  ")
    tidy = F.regexp_replace(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "), r"(?<![^\x20])[^0-9\x20]*+[0-9][^\x20]*+", VARIABLE)
    masked = F.trim(F.when(odd, tidy).otherwise(line))
    rows = lines.withColumns({"masked": masked, "chars": F.length("line")}).where(~F.col("masked").rlike(r"^(<\*>( |$))*$")).drop("line")
    rows = rows.withColumn("n", F.size(F.split("masked", " ")))
    head = F.call_function("substring_index", "masked", F.lit(" "), F.lit(LEADING))
    return rows.withColumns({"own": F.xxhash64("masked"), "lead": F.xxhash64(head), "leaf": F.xxhash64("n", head)})


def _recurring(rows: DataFrame, key: str, unit: list[str], least: Column) -> DataFrame:
    """``key`` and the smallest ``unit`` of the keys that enough units have; a unit is one row for each key before keys meet."""
    once = rows.groupBy(key, *unit).agg(F.min(F.struct("doc_id")).alias("id"), F.min("n").alias("n"))
    counted = once.groupBy(key).agg(F.count(F.lit(1)).alias("units"), F.min("n").alias("n"), F.min(F.struct("id", *unit)).alias("first"))
    return counted.where(F.col("units") >= least).select(key, "first")


def _others(rows: DataFrame, recurring: DataFrame, key: str, unit: list[str]) -> DataFrame:
    """The places of the rows with a recurring key outside of the first unit that has it."""
    same = F.lit(True)
    for c in unit:
        same = same & F.col(c).eqNullSafe(F.col(f"first.{c}"))
    return rows.join(recurring, key).where(~same).select("doc_id", "mark", "place")


def _maybe_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` (a hash) isn't in ``wanted``, by a broadcast bitmap of bounded size, so that the others needn't be shuffled with their text."""
    place = F.pmod(F.col(key), F.lit(FILTER_BITS))
    bitmaps = wanted.select(F.floor(place / ROW_BITS).alias("__row"), (place % ROW_BITS).alias("__bit")).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    found = rows.withColumns({"__row": F.floor(place / ROW_BITS), "__bit": place % ROW_BITS}).join(F.broadcast(bitmaps), "__row")
    byte = F.expr("CAST(conv(hex(substring(__bits, CAST(__bit div 8 AS INT) + 1, 1)), 16, 10) AS BIGINT)")
    return found.where(F.call_function("shiftright", byte, (F.col("__bit") % 8).cast("int")) % 2 == 1).select(rows.columns)


def _templates(lines: DataFrame) -> DataFrame:
    """cluster, ``t`` (the kept token of each position, null where it is variable) and ``split``, the position with the fewest different tokens, from two on (the first of those)."""
    tokens = lines.select("cluster", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    votes = tokens.groupBy("cluster", "at", "token").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("cluster", "at").agg(F.max_by("token", F.struct("votes", "token")).alias("token"), F.max("votes").alias("most"), F.sum("votes").alias("lines"), F.count(F.lit(1)).alias("kinds"))
    kept = F.when((2 * F.col("most") > F.col("lines")) & (F.col("token") != VARIABLE), F.col("token"))
    templates = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", kept.alias("token")))).alias("t"), F.min(F.when(F.col("kinds") > 1, F.struct("kinds", "at"))).alias("split"))
    return templates.select("cluster", F.transform("t", lambda x: x["token"]).alias("t"), F.col("split.at").alias("split"))


def generalised(cut: DataFrame) -> DataFrame:
    """``own`` of the lines that agree with a template of their leaf, where a leaf that could recur has one that keeps enough, and the template."""
    longer = cut.where(F.col("n") > LEADING)
    busy = longer.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.min("own").alias("a"), F.max("own").alias("b"))
    busy = written(busy.where((F.col("rows") >= LEAST_DOCS) & (F.col("a") != F.col("b"))).select("leaf"), "busy")
    lines = written(_maybe_in(longer, "leaf", busy).join(busy, "leaf").groupBy(F.col("leaf").alias("cluster"), "own").agg(F.min("masked").alias("masked")), "leaves")
    found = None
    for left in reversed(range(SPLITS + 1)):
        both = lines.join(_templates(lines), "cluster")
        tokens = F.split("masked", " ")
        enough = 100 * F.size(F.filter("t", lambda x: x.isNotNull())) >= LEAST_KEPT * F.size("t")
        agrees = F.forall(F.zip_with("t", tokens, lambda t, x: t.isNull() | (t == x)), lambda x: x)
        judged = written(both.select("cluster", "own", "masked", (enough & agrees).alias("fits"), F.get(tokens, F.col("split")).alias("token")), "judged")
        fits = judged.where("fits").select("own", F.col("cluster").alias("template"))
        found = fits if found is None else found.unionByName(fits)
        if left:
            lines = judged.where("NOT fits AND token IS NOT NULL").select(F.xxhash64("cluster", "token").alias("cluster"), "own", "masked")
            # A line alone is no template of its own
            several = lines.groupBy("cluster").agg(F.min("own").alias("a"), F.max("own").alias("b")).where(F.col("a") != F.col("b")).select("cluster")
            lines = written(lines.join(several, "cluster"), "clusters")
    return found


def mostly_shared(thin: DataFrame, share: float) -> DataFrame:
    """``mark`` of the texts with more than ``share`` of their characters in lines that begin as lines of another text do: copies, edited or not."""
    begun = thin.groupBy("lead").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where(F.col("a") != F.col("b")).select("lead", F.lit(True).alias("shared"))
    of = thin.select("mark", "lead", "chars").join(begun, "lead", "left").groupBy("mark").agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("shared"), F.col("chars"))).alias("shared"))
    return of.where(F.col("shared") > share * F.col("chars")).select("mark")


def drops(docs: DataFrame, *, text: str = "text", by_text: bool = False, most_shared: float = 1.0) -> DataFrame:
    """doc_id, mark (a hash of the text) and ``dropped``, the places (from 0) of the lines to drop, for documents that lose any."""
    unit = ["mark"] if by_text else ["doc_id", "mark"]
    marked = docs.select("doc_id", F.col(text).cast("string").alias("text")).where("text IS NOT NULL").withColumn("mark", F.xxhash64("text"))
    lines = marked.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    cut = written(parsed(lines), "lines")
    thin = cut.drop("masked")
    found = _others(thin, _recurring(thin, "own", unit, F.when(F.col("n") >= LONG, LEAST_DOCS_LONG).otherwise(LEAST_DOCS)), "own", unit)
    fitting = thin.join(generalised(cut), "own")
    more = _others(fitting, _recurring(fitting, "template", unit, F.lit(LEAST_DOCS)), "template", unit)
    gone = found.unionByName(more).groupBy("doc_id", "mark").agg(F.collect_set("place").alias("dropped"))
    return gone if most_shared >= 1 else gone.join(mostly_shared(thin, most_shared), "mark", "left_anti")


def without_templates(docs: DataFrame, *, text: str = "text", by_text: bool = False, most_shared: float = 1.0, gone: DataFrame | None = None) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and ``n_lines`` and ``n_dropped`` (columns so named are replaced).

    Lines end at a newline; blank ones, and those of variable fields only, always stay.  A line
    recurs if ``LEAST_DOCS`` documents have it, a long one from ``LEAST_DOCS_LONG`` on, digits aside; a
    template if ``LEAST_DOCS`` have lines of it.  Rows that agree in id and text are one document.
    The document with the smallest id (a null id is smallest; ties: by a hash of the text) keeps
    its lines.  What other documents have in place of a variable field goes with the line.  A
    null text stays null with no lines, an empty one is one line.  No row is dropped; an empty table
    gives an empty one.

    ``by_text``, all rows of a text are one document, so copies of a text lose nothing to each other.  A
    document with more than the share ``most_shared`` of its characters in lines that begin as lines of
    other texts do, by their leading tokens, is a copy, edited or not, and stays as it is.

    ``gone`` is what ``drops`` gives for ``docs``, where the caller has stored that.
    """
    gone = (drops(docs, text=text, by_text=by_text, most_shared=most_shared) if gone is None else gone).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("dropped").alias("__dropped"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.xxhash64(F.col(text).cast("string")).alias("__own"))
    rows = rows.join(gone, F.col("__own").eqNullSafe(F.col("__mark")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = F.split(text, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    rebuilt = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    out = {text: F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(rebuilt)}
    return rows.select(
        *(out.get(c, F.col(f"`{c}`")).alias(c) for c in kept),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _rounds() -> str:
    """The lines of each round's clusters, the templates of these, and the lines that fit, in SQL."""
    cluster = "n, head, path"
    parts = [f"lines0 AS MATERIALIZED (SELECT DISTINCT n, head, []::VARCHAR[] AS path, tokens FROM sized WHERE n > {LEADING})"]
    for k in range(SPLITS + 1):
        kept = f"2 * most > lines AND token <> '{VARIABLE}'"
        parts += [
            f"several{k} AS (SELECT {cluster} FROM lines{k} GROUP BY {cluster} HAVING count(*) > 1)",
            f"placed{k} AS (SELECT {cluster}, unnest(tokens) AS token, unnest(range(1, n + 1)) AS pos FROM lines{k} JOIN several{k} USING ({cluster}))",
            f"votes{k} AS (SELECT {cluster}, pos, token, count(*) AS votes FROM placed{k} GROUP BY {cluster}, pos, token)",
            f"best{k} AS (SELECT {cluster}, pos, arg_max(token, votes) AS token, max(votes) AS most, sum(votes) AS lines, count(*) AS kinds FROM votes{k} GROUP BY {cluster}, pos)",
            f"templates{k} AS (SELECT {cluster}, list(CASE WHEN {kept} THEN token END ORDER BY pos) AS t, count(*) FILTER ({kept}) AS kept, (min({{'kinds': kinds, 'pos': pos}}) FILTER (kinds > 1)).pos AS split FROM best{k} GROUP BY {cluster})",
            f"judged{k} AS MATERIALIZED (SELECT {cluster}, tokens, tokens[split] AS token, 100 * kept >= {LEAST_KEPT} * n AND len(list_filter(range(1, n + 1), lambda i: t[i] IS NOT NULL AND t[i] <> tokens[i])) = 0 AS fits FROM lines{k} JOIN templates{k} USING ({cluster}))",
            f"fit{k} AS (SELECT {cluster}, tokens FROM judged{k} WHERE fits)",
            f"lines{k + 1} AS (SELECT n, head, list_append(path, token) AS path, tokens FROM judged{k} WHERE NOT fits AND token IS NOT NULL)",
        ]
    return ",\n".join(parts)


#: The same with the lines and templates themselves instead of their hashes, for ids that are unique.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS place FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, place, list_filter(regexp_split_to_array(regexp_replace(line, '[^0-9\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '{VARIABLE}', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS tokens FROM lines),
sized AS (SELECT *, len(tokens) AS n, list_slice(tokens, 1, {LEADING}) AS head FROM cut WHERE len(list_filter(tokens, lambda x: x <> '{VARIABLE}')) > 0),
own AS (SELECT n, tokens, min(doc_id) AS first FROM sized GROUP BY n, tokens HAVING count(DISTINCT doc_id) >= CASE WHEN n >= {LONG} THEN {LEAST_DOCS_LONG} ELSE {LEAST_DOCS} END),
{_rounds()},
fitting AS (SELECT s.doc_id, s.place, f.n, f.head, f.path FROM sized s JOIN ({" UNION ALL ".join(f"SELECT * FROM fit{k}" for k in range(SPLITS + 1))}) f ON s.n = f.n AND s.tokens = f.tokens),
recurring AS (SELECT n, head, path, min(doc_id) AS first FROM fitting GROUP BY n, head, path HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
gone AS (
  SELECT doc_id, place FROM sized JOIN own USING (n, tokens) WHERE doc_id <> first
  UNION SELECT doc_id, place FROM fitting JOIN recurring USING (n, head, path) WHERE doc_id <> first),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.place) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (g.place IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, sha256(k.text) AS text_sha256 FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
