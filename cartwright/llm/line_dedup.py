"""Line dedup: repeated passages of lines, in chunks that their content delimits.

A rolling hash runs over the hashes of a text's lines with words, two neighbours at a time.
A chunk is a longest run of lines whose rolling hashes all stand earlier in the corpus, one
after the other in one document; its boundaries lie where the rolling hash is new or the
earlier text goes on otherwise. They depend on the lines there alone, so a passage is cut out
the same wherever it is shifted to. One line of many words is hashed as a chunk of its own.

Removed are chunks of two or more lines (or one long line) with enough words whose bytes
equal those of the earlier occurrence, which is kept: hashes whose first occurrence would
lose a line to another chunk remove nothing, so no passage is broken up where it stands first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.sources.staging import stage

#: Lines in the window of the rolling hash, so in the shortest chunk.
WINDOW_LINES = 2
#: A single line with more words is a chunk too.
LINE_WORDS = 50
#: Words in the shortest chunk: closing brackets, "yes" and "no" repeat everywhere.
LEAST_WORDS = 10

WORD = r"[^\x20\x09-\x0D]+"
PLACE = ["id", "mark"]


def _order(id_column: str) -> Column:
    """The id as a number, a null id as one beyond all longs."""
    beyond = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.coalesce(F.col(id_column).cast("decimal(20,0)"), beyond)


def _with(value: Column, function) -> Column:
    """``function`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), function)[0]


def _windows(lines: Column, line_words: int) -> Column:
    """The rolling hash at each two neighbouring lines with words, and each long line's hash."""

    def measured(line: Column, i: Column) -> Column:
        words = F.regexp_count(line, F.lit(WORD))
        return F.struct(F.xxhash64(line).alias("hash"), words.alias("words"), i.alias("i"))

    def window(q, kind, first, last, digest, words, new) -> Column:
        return F.struct(
            q.cast("int").alias("at"),
            F.lit(kind).alias("kind"),
            first["i"].alias("first"),
            (last["i"] + 1).alias("last"),
            digest.alias("hash"),
            words.cast("long").alias("words"),
            new.cast("long").alias("new_words"),
        )

    def of(filled: Column) -> Column:
        n = F.size(filled)
        starts = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(
            F.array().cast("array<int>")
        )

        def pair(q: Column) -> Column:
            a, b = F.get(filled, q), F.get(filled, q + 1)
            rolled = F.xxhash64(a["hash"], b["hash"])
            return window(q, WINDOW_LINES, a, b, rolled, a["words"] + b["words"], b["words"])

        def single(x: Column, q: Column) -> Column:
            return window(q, 1, x, x, F.xxhash64(x["hash"], F.lit(1)), x["words"], x["words"])

        long = F.filter(F.transform(filled, single), lambda w: w["words"] > line_words)
        return F.concat(F.transform(starts, pair), long)

    return _with(F.filter(F.transform(lines, measured), lambda x: x["words"] > 0), of)


def line_windows(
    docs: DataFrame, id_column: str, text_column: str, line_words: int = LINE_WORDS
) -> DataFrame:
    """``id, mark, at, kind, first, last, hash, words, new_words`` of each window.

    ``mark`` is a hash of the text, ``at`` counts lines with words, ``first`` and ``last`` all
    lines, from 0 (``last`` exclusive); ``new_words`` are those of the window's last line.
    """
    text = F.col(text_column)
    return docs.where(F.length(text) > 0).select(
        _order(id_column).alias("id"),
        F.xxhash64(text).alias("mark"),
        F.inline(_windows(F.split(text, "\n", -1), line_words)),
    )


def _chunks(windows: DataFrame, least_words: int) -> DataFrame:
    """Longest runs of windows whose earlier occurrences run along, with enough words."""
    along = [*PLACE, "kind", "kept_id", "kept_mark", "shift"]
    shifted = windows.withColumn("shift", F.col("kept_at") - F.col("at"))
    place = F.row_number().over(W.partitionBy(*along).orderBy("at"))
    runs = shifted.withColumn("run", F.col("at") - place).groupBy(*along, "run")
    return runs.agg(
        F.min("at").alias("at"),
        (F.max("at") + F.max("kind")).alias("after"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        (F.sum("new_words") + F.min_by(F.col("words") - F.col("new_words"), "at")).alias("words"),
    ).where(F.col("words") >= least_words)


def repeated_chunks(windows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``id, mark, first, last, kept_id, kept_mark, kept_at, lines`` of the chunks to remove.

    Equal hashes are merged in each task before they meet, so a passage that half of all
    documents share is one row per task; where its windows are joined to its first
    occurrence, Spark splits the rows of the hash.
    """
    first_place = F.min(F.struct("id", "mark", "at"))
    firsts = (
        windows.groupBy("kind", "hash")
        .agg(first_place.alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(
            "kind", "hash", F.col("kept.id").alias("kept_id"),
            F.col("kept.mark").alias("kept_mark"), F.col("kept.at").alias("kept_at"),
        )
    )
    same_text = (F.col("id") == F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    # a window that overlaps its own first occurrence is no second one
    later = ~same_text | (F.col("at") >= F.col("kept_at") + F.col("kind"))
    again = stage(
        windows.join(firsts, ["kind", "hash"]).where(later).dropDuplicates([*PLACE, "kind", "at"]),
        "line-windows-again",
    )
    lost = _chunks(again, least_words).select(
        *PLACE, F.explode(F.sequence("at", F.col("after") - 1)).alias("line")
    )
    held = again.select("kind", "hash", "kept_id", "kept_mark", "kept_at").distinct().select(
        "kind", "hash", F.col("kept_id").alias("id"), F.col("kept_mark").alias("mark"),
        F.explode(F.sequence("kept_at", F.col("kept_at") + F.col("kind") - 1)).alias("line"),
    )
    broken = held.join(lost.distinct(), [*PLACE, "line"]).select("kind", "hash").distinct()
    sound = again.join(broken, ["kind", "hash"], "left_anti")
    return _chunks(sound, least_words).select(
        *PLACE, "first", "last", "kept_id", "kept_mark",
        (F.col("at") + F.col("shift")).alias("kept_at"),
        (F.col("after") - F.col("at")).alias("lines"),
    )


def _with_words(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.regexp_count(x, F.lit(WORD)) > 0)


def _unequal(marked: DataFrame, lines: Column) -> DataFrame:
    """``ref`` of first occurrences whose bytes are not those of all chunks removed for them.

    Texts of a chunk are merged in each task, so a frequent passage travels once per task.
    """

    def text(part: Column) -> Column:
        return F.array_join(part, "\n")

    def cut(parts: Column, g: Column) -> Column:
        return text(_with_words(F.slice(parts, g["first"] + 1, g["last"] - g["first"])))

    own = marked.where(F.size("gone") > 0).select(
        F.explode(
            _with(
                lines,
                lambda parts: F.transform(
                    "gone",
                    lambda g: F.struct(g["ref"].alias("ref"), cut(parts, g).alias("text")),
                ),
            )
        ).alias("c")
    )
    kept = marked.where(F.size("held") > 0).select(
        F.explode(
            _with(
                _with_words(lines),
                lambda filled: F.transform(
                    "held",
                    lambda h: F.struct(
                        h["ref"].alias("ref"),
                        text(F.slice(filled, h["at"] + 1, h["lines"])).alias("text"),
                    ),
                ),
            )
        ).alias("c")
    )
    texts = own.unionByName(kept).select("c.*").groupBy("ref", "text").agg(F.count(F.lit(1)))
    return texts.groupBy("ref").count().where(F.col("count") > 1).select("ref")


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    line_words: int = LINE_WORDS,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``row, text, lines_removed``: each row, its text without repeated chunks, and a count.

    A text is its parts between line feeds; what is left is joined by line feeds again. First
    is the occurrence with the least id, then the least hash of its text, then the first line;
    null ids come last. Null and empty texts, and short texts of one line, stay as they are.
    Lines without a word (blanks, tabs, carriage returns) are no lines of a chunk, but go with
    the lines around them. Rows that share an id and a text are one document and lose the same
    lines. An empty table gives no rows.
    """
    windows = stage(line_windows(docs, id_column, text_column, line_words), "line-windows")
    found = stage(
        repeated_chunks(windows, least_words).withColumn(
            "ref", F.struct("kept_id", "kept_mark", "kept_at", "lines")
        ),
        "line-chunks",
    )
    ref = F.xxhash64(F.col("ref.kept_id").cast("string"), "ref.kept_mark", "ref.kept_at", "ref.lines")
    gone = found.groupBy(*PLACE).agg(
        F.collect_list(F.struct("first", "last", ref.alias("ref"))).alias("gone")
    )
    held = found.select("ref").distinct().select(
        F.col("ref.kept_id").alias("id"), F.col("ref.kept_mark").alias("mark"),
        F.struct(
            F.col("ref.kept_at").alias("at"), F.col("ref.lines").alias("lines"), ref.alias("ref")
        ).alias("held"),
    )
    held = held.groupBy(*PLACE).agg(F.collect_list("held").alias("held"))
    spans = gone.join(held, PLACE, "full_outer")
    rows = docs.select(
        F.struct("*").alias("row"),
        _order(id_column).alias("id"),
        F.coalesce(F.xxhash64(text_column), F.lit(0)).alias("mark"),
    )
    none = F.array()
    marked = stage(
        rows.join(spans, PLACE, "left").select(
            "row",
            F.coalesce("gone", none.cast(gone.schema["gone"].dataType)).alias("gone"),
            F.coalesce("held", none.cast(held.schema["held"].dataType)).alias("held"),
        ),
        "line-spans",
    )
    text = F.col("row")[text_column]
    lines = F.split(text, "\n", -1)
    unequal = stage(_unequal(marked, lines), "line-unequal")
    if not unequal.isEmpty():
        marked = _without(marked, unequal)

    def rest(parts: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(parts) - 1)
        lost = F.flatten(F.transform("gone", lambda g: F.sequence(g["first"], g["last"] - 1)))
        kept = F.array_except(at, lost)
        return F.struct(
            F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n").alias("text"),
            (F.size(parts) - F.size(kept)).cast("long").alias("lines_removed"),
        )

    whole = F.struct(text.alias("text"), F.lit(0).cast("long").alias("lines_removed"))
    left = F.when(F.size("gone") == 0, whole).otherwise(_with(lines, rest))
    return marked.select("row", left.alias("left")).select("row", "left.text", "left.lines_removed")


def _without(marked: DataFrame, unequal: DataFrame) -> DataFrame:
    """``marked`` without the spans whose hashes met by chance; few rows have any."""
    numbered = stage(marked.withColumn("n", F.expr("uuid()")), "line-rows")
    spans = numbered.select("n", F.explode("gone").alias("g"))
    equal = spans.join(unequal, F.col("g.ref") == F.col("ref"), "left_anti")
    again = equal.groupBy("n").agg(F.collect_list("g").alias("sound"))
    return numbered.join(again, "n", "left").select(
        "row",
        F.coalesce("sound", F.array().cast(marked.schema["gone"].dataType)).alias("gone"),
        "held",
    )


def statement() -> str:
    """The same texts with the lines themselves in place of hashes."""

    def chunks(windows: str) -> str:
        return f"""
  SELECT id, kind, min(pos) AS pos, max(pos) + kind AS after, min(first) AS first,
    max(last) AS last, sum(new_words) + arg_min(words - new_words, pos) AS words
  FROM (SELECT *, pos - row_number() OVER (
          PARTITION BY id, kind, kept_id, shift ORDER BY pos) AS run FROM {windows})
  GROUP BY id, kind, kept_id, shift, run HAVING words >= {LEAST_WORDS}"""

    return f"""
WITH parts AS (
  SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents WHERE length(text) > 0
),
every AS (SELECT id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM parts),
filled AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos FROM (
    SELECT *, len(regexp_extract_all(line, '{WORD}')) AS words FROM every) WHERE words > 0
),
windows AS (
  SELECT a.id, a.pos, 2 AS kind, a.i AS first, b.i + 1 AS last, a.line || chr(10) || b.line AS body,
    a.words + b.words AS words, b.words AS new_words
  FROM filled a JOIN filled b ON a.id = b.id AND b.pos = a.pos + 1
  UNION ALL SELECT id, pos, 1, i, i + 1, line, words, words FROM filled WHERE words > {LINE_WORDS}
),
placed AS (
  SELECT *, first_value(id) OVER w AS kept_id, first_value(pos) OVER w AS kept_at
  FROM windows WINDOW w AS (PARTITION BY kind, body ORDER BY id, pos)
),
again AS (
  SELECT *, kept_at - pos AS shift FROM placed WHERE id <> kept_id OR pos >= kept_at + kind
),
all_chunks AS ({chunks("again")}),
lost AS (SELECT DISTINCT id, unnest(range(pos, after)) AS line FROM all_chunks),
held AS (
  SELECT DISTINCT kind, body, kept_id AS id, unnest(range(kept_at, kept_at + kind)) AS line FROM again
),
broken AS (SELECT DISTINCT kind, body FROM held JOIN lost USING (id, line)),
sound AS (SELECT * FROM again ANTI JOIN broken USING (kind, body)),
sound_chunks AS ({chunks("sound")}),
gone AS (SELECT DISTINCT id, unnest(range(first, last)) AS i FROM sound_chunks),
rest AS (
  SELECT id, string_agg(line, chr(10) ORDER BY i) AS text FROM every ANTI JOIN gone USING (id, i)
  GROUP BY id
),
counted AS (SELECT id, count(*) AS n FROM gone GROUP BY id)
SELECT d.doc_id, CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(r.text, '') END AS text,
  coalesce(c.n, 0) AS lines_removed
FROM documents d LEFT JOIN counted c ON c.id = d.doc_id LEFT JOIN rest r ON r.id = d.doc_id
"""
