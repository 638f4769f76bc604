r"""Line dedup by a tree of line templates (DataFrame operations only).

The tree has fixed depth: a line goes down by its number of tokens, then by its
`LEAD` first tokens, with tokens that hold a digit masked as variable. In a leaf,
a token keeps its place in the template if lines of at least `MIN_TEXTS` texts
have it there, else its place is a variable field; no order of arrival matters.
A line of `LEAD` tokens or fewer goes down by all of them; one without tokens has no
leaf. The tokens by which a line went down are the same in the whole leaf, so they say
nothing about a template: a line has one if at least half of its further tokens (of
all of them, where there are no further ones) are fixed.

A template recurs if lines of at least `MIN_TEXTS` different texts have it (equal
texts count once: whole copies are for document dedup). A recurring template's
lines are dropped everywhere but in its home, the text with the smallest id that
has it, and that text's copies: what it says stays in the corpus once.

As data grow, each value of a variable field comes to keep its place, and one
template falls apart into combinations that are rare one by one. So each template
has a stem: of the line's further tokens that are fixed the most frequent ones of the
leaf, half as many as the line has further tokens. Constants are at least as frequent as the values of
fields, so combinations of one template share their stem, at every size. Lines
whose template does not recur but whose stem does go with their stem: they are
dropped everywhere but in the stem's home.

Only lines in leaves with `MIN_TEXTS` lines or more are moved about, lines, leaves
and templates by 128-bit hashes; different lines are counted before their tokens
are looked at, and tokens are never gathered: a stem takes a sort of each line's.

Defined results: lines are split at "\n" and kept lines are joined by it again,
so a text without dropped lines is unchanged; a null text stays null with 0
lines, an empty one has one empty line; rows with equal id and text are treated
alike; null ids come before all others; an empty table gives an empty result.
All input columns come back in `row`, so their names don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapevigil.llm.common import WORD, stored
from tapevigil.llm.substring import keyed, same_row

LEAD, MIN_TEXTS = 3, 10
FIELD = "<*>"

#: 128-bit names of a line, a leaf and, within a leaf, a template.
LINE, LEAF = ["l1", "l2"], ["h1", "h2"]
TEMPLATE = [*LEAF, "p1", "p2"]
#: Within a leaf, a stem.
STEM = [*LEAF, "s1", "s2"]


def named(value: Column, names: list[str]) -> list[Column]:
    """Two hashes that stand for a value."""
    return [F.xxhash64(F.lit(i), value).alias(name) for i, name in enumerate(names)]


def single_spaced(line: Column) -> Column:
    """A line's tokens with one space between them."""
    other = [F.contains(line, F.lit(space)) for space in ("\t", "\x0b", "\x0c", "\r", "  ")]
    return F.trim(F.when(reduce(Column.__or__, other), F.regexp_replace(line, "[\t\x0b\x0c\r ]+", " ")).otherwise(line))


def parsed(keys: DataFrame, lead: int) -> DataFrame:
    """(d, t, at, line, tokens, n, leaf) of every line; t names a text, leaf is "" for a line without tokens."""
    lines = keys.select("d", "t", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.withColumn("tokens", single_spaced(F.col("line")))
    spaces = F.octet_length("tokens") - F.octet_length(F.replace("tokens", F.lit(" "), F.lit("")))
    n = F.when(F.col("tokens") == "", 0).otherwise(spaces + 1)
    first = F.regexp_replace(F.substring_index("tokens", " ", lead), "[^ ]*[0-9][^ ]*", FIELD)
    leaf = F.when(F.col("n") >= 1, F.concat_ws(" ", F.col("n").cast("string"), first)).otherwise("")
    return lines.withColumn("n", n).withColumn("leaf", leaf)


def candidates(keys: DataFrame, lead: int, min_texts: int) -> DataFrame:
    """The lines of leaves with at least `min_texts` lines, with their names; written once."""
    lines = parsed(keys, lead)
    leaf = named(F.col("leaf"), LEAF)
    nowhere = F.xxhash64(F.lit(0), F.lit(""))
    full = stored(lines.groupBy(leaf[0]).count().filter((F.col("count") >= min_texts) & (F.col("h1") != nowhere)).select("h1"))
    return stored(lines.select("d", "t", "at", *named(F.col("line"), LINE), *leaf, "n", "tokens").join(full, "h1", "left_semi"))


def templates(lines: DataFrame, lead: int, min_texts: int) -> DataFrame:
    """The template and stem of each different line of candidates that has one: LINE, TEMPLATE and STEM."""
    texts = lines.groupBy(*LINE).agg(F.countDistinct("t").alias("texts"))
    one = lines.groupBy(*LINE).agg(*[F.first(c).alias(c) for c in (*LEAF, "n", "tokens")])
    different = stored(one.join(texts, LINE))
    placed = different.select(*LINE, *LEAF, "n", "texts", F.posexplode(F.split("tokens", " ")).alias("at", "token"))
    placed = placed.filter(~F.col("token").rlike("[0-9]")).withColumn("token", F.xxhash64("token"))
    place = [*LEAF, "at", "token"]
    fixed = stored(placed.groupBy(*place).agg(F.sum("texts").alias("texts")).filter(F.col("texts") >= min_texts).select(*place, F.col("texts").alias("often")))
    short = F.col("n") <= lead
    kept = placed.join(fixed, place).withColumn("further", short | (F.col("at") >= lead))
    first = Window.partitionBy(*LINE).orderBy(F.desc("further"), F.desc("often"), "at")
    kept = kept.withColumn("of", F.when(short, F.col("n")).otherwise(F.col("n") - lead)).withColumn("turn", F.row_number().over(first))
    # The set of fixed places names the template; its hash does not depend on their order.
    hashes = [F.xxhash64(F.lit(i), "at", "token") for i in range(2)]
    half = F.col("further") & (F.col("turn") * 2 <= F.col("of") + 1)
    sums = [F.bit_xor(h).alias(f"p{i + 1}") for i, h in enumerate(hashes)]
    sums += [F.bit_xor(F.when(half, h)).alias(f"s{i + 1}") for i, h in enumerate(hashes)]
    found = kept.groupBy(*LINE, *LEAF, "of").agg(F.count_if("further").alias("fixed"), *sums)
    return found.filter(F.col("fixed") * 2 >= F.col("of")).select(*LINE, *TEMPLATE, *STEM[2:])


def homes(found: DataFrame, name: list[str], min_texts: int, home: str) -> DataFrame:
    """The names that lines of at least `min_texts` texts have, and the first of these texts (d, t)."""
    often = found.groupBy(*name).agg(F.countDistinct("t").alias("texts"), F.min(F.struct("d", "t")).alias(home))
    return stored(often.filter(F.col("texts") >= min_texts).select(*name, home))


def recurring(lines: DataFrame, lead: int, min_texts: int) -> DataFrame:
    """(d, t, at, home) of the candidate lines whose template or stem recurs; home (d, t) is the first text that has it."""
    found = stored(lines.select("d", "t", "at", *LINE).join(stored(templates(lines, lead, min_texts)), LINE).drop(*LINE))
    # A template that recurs has a stem that does.
    found = found.join(homes(found, STEM, min_texts, "stem_home"), STEM)
    found = found.join(homes(found, TEMPLATE, min_texts, "own_home"), TEMPLATE, "left")
    return found.withColumn("home", F.coalesce("own_home", "stem_home"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lead: int = LEAD, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(row, n_lines, n_removed, kept) for every row; kept is the text without its dropped lines."""
    keys = keyed(docs, id_col, text_col)
    dropped = recurring(candidates(keys, lead, min_texts), lead, min_texts).filter(F.col("home.t") != F.col("t"))
    gone = dropped.groupBy("d", "t").agg(F.collect_set("at").alias("gone"))
    out = keys.select("d", "t", "row").alias("x").join(gone.alias("y"), same_row("x", "y"), "left").select("x.row", "y.gone")
    text = F.col("row").getField(text_col)
    # The one-row generator keeps the split from being done anew for every line that is looked up.
    lines = F.when(F.col("gone").isNotNull(), F.split(text, "\n", -1))
    out = out.select("row", "gone", F.explode(F.array(lines)).alias("lines"))
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    return out.select(
        "row", F.coalesce(newlines + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n")).alias("kept"),
    )


SQL = rf"""
WITH rows AS (SELECT DISTINCT coalesce(doc_id, -9223372036854775808) AS d, md5(text) AS t, text FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT d, t, nr, split[nr] AS line
  FROM (SELECT *, unnest(range(1, len(split) + 1)) AS nr FROM (SELECT d, t, string_split(text, chr(10)) AS split FROM rows))),
parsed AS (SELECT *, regexp_extract_all(line, '{WORD}') AS tokens FROM lines),
leaves AS (
  SELECT *, len(tokens) || ' ' || array_to_string(list_transform(tokens[1:{LEAD}], lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{FIELD}' ELSE w END), ' ') AS leaf
  FROM parsed WHERE len(tokens) >= 1),
uniq AS (SELECT leaf, line, any_value(tokens) AS tokens, count(DISTINCT t) AS texts FROM leaves GROUP BY leaf, line),
placed AS (
  SELECT leaf, line, texts, len(tokens) <= {LEAD} OR i > {LEAD} AS further, CASE WHEN len(tokens) <= {LEAD} THEN len(tokens) ELSE len(tokens) - {LEAD} END AS n,
    i AS place, tokens[i] AS token
  FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM uniq) WHERE NOT regexp_matches(tokens[i], '[0-9]')),
fixed AS (SELECT leaf, place, token, sum(texts) AS often FROM placed GROUP BY leaf, place, token HAVING sum(texts) >= {MIN_TEXTS}),
turns AS (
  SELECT placed.*, row_number() OVER (PARTITION BY leaf, line ORDER BY further DESC, often DESC, place) AS turn
  FROM placed JOIN fixed USING (leaf, place, token)),
templates AS (
  SELECT leaf, line, list((place, token) ORDER BY place) AS template,
    list((place, token) ORDER BY place) FILTER (further AND turn * 2 <= n + 1) AS stem
  FROM turns GROUP BY leaf, line, n HAVING count(*) FILTER (further) * 2 >= n),
named AS (SELECT d, t, nr, leaf, template, stem FROM leaves JOIN templates USING (leaf, line)),
own AS (SELECT leaf, template, min({{'d': d, 't': t}}) AS home FROM named GROUP BY leaf, template HAVING count(DISTINCT t) >= {MIN_TEXTS}),
stems AS (SELECT leaf, stem, min({{'d': d, 't': t}}) AS home FROM named GROUP BY leaf, stem HAVING count(DISTINCT t) >= {MIN_TEXTS}),
gone AS (
  SELECT DISTINCT d, t, nr
  FROM named JOIN stems ON named.leaf = stems.leaf AND named.stem = stems.stem
  LEFT JOIN own ON named.leaf = own.leaf AND named.template = own.template
  WHERE t <> coalesce(own.home, stems.home)['t']),
kept AS (
  SELECT d, t, list(line ORDER BY nr) FILTER (gone.nr IS NULL) AS kept, count(gone.nr) AS n_removed, count(*) AS n_lines
  FROM lines LEFT JOIN gone USING (d, t, nr) GROUP BY d, t)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept.kept, chr(10)), '') END) AS kept_sha256
FROM documents LEFT JOIN kept ON coalesce(doc_id, -9223372036854775808) = kept.d AND md5(text) = kept.t
"""
