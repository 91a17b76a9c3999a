"""Compliance operators over the given tables, lifted to deck shape, each with its SQL.

A conversation is a deck and a turn a slide, with the user's text as title, the assistant's as body and the
system's as footer; an order is a table and its lines are cells; a part's key gives a colour. Word lists, palettes and
thresholds are parameters, so the operators are those of the deck rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decklake.functions import constants as C
from decklake.functions import scalars as S
from decklake.operators import aggregates as A
from decklake.operators import fixes as X
from decklake.operators import review as V
from decklake.operators import rules as R
from decklake.operators.algebra import coalesced, collapse, mode_of, outliers, primary, prioritised, prioritised_in, ranked, summary, suppressed
from decklake.operators.spatial import touching

#: White space as a pattern of both engines.
SPACE = f"[{S.WHITE}]+"
WORD = "(?<![A-Za-z0-9_])%s(?![A-Za-z0-9_])"
TERMS = {"term-the": "the", "term-and": "and", "term-que": "que", "term-der": "der"}
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").where(F.col("role") == role).select("conv_id", (F.col("turn") + 1).alias("slide_index"), "text")


def title_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _turns(spark, sf_dir, "user").withColumn("title", S.one_line(F.col("text"))).where("title <> ''")
    long = S.estimated_lines(F.col("title"), C.TITLE_SIZE_PT) > C.TITLE_LINES
    hits = F.array_compact(F.array(F.when(S.ends_with_punctuation(F.col("title")), "title-punct"), F.when(long, "title-lines")))
    return titles.select("conv_id", "slide_index", F.explode(hits).alias("rule_id"))


_TITLES = rf"""titles AS (SELECT conv_id, turn + 1 AS slide_index, trim(regexp_replace(text, '{SPACE}', ' ', 'g'), ' ') AS title FROM conversations WHERE role = 'user'),
found AS (SELECT conv_id, slide_index, 'title-punct' AS rule_id FROM titles WHERE title <> '' AND regexp_matches(title, '[.,;]$')
UNION ALL SELECT conv_id, slide_index, 'title-lines' FROM titles WHERE title <> '' AND ceil(length(title) / 51.0::DOUBLE) > 3)"""


@query(f"WITH {_TITLES} SELECT conv_id, slide_index, rule_id FROM found")
def title_punct_and_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that end in punctuation or fill more than three lines."""
    return title_findings(spark, sf_dir)


def bullet_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _turns(spark, sf_dir, "assistant")
    bullets = F.filter(F.split("text", "\n"), lambda p: ~S.is_blank(p))
    marked = F.filter("bullets", lambda p: S.ends_with_punctuation(p, ".;"))
    rows = bodies.select("conv_id", "slide_index", bullets.alias("bullets")).withColumn("n_punct", F.size(marked).cast("long"))
    return rows.where((F.size("bullets") >= 2) & (F.col("n_punct") > 0)).select("conv_id", "slide_index", F.size("bullets").cast("long").alias("n_bullets"), "n_punct")


_BULLETS = rf"""bullets AS (SELECT conv_id, turn + 1 AS slide_index, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '{SPACE}', ' ', 'g'), ' ')), lambda p: p <> '') AS b FROM conversations WHERE role = 'assistant'),
marked AS (SELECT conv_id, slide_index, len(b)::BIGINT AS n_bullets, len(list_filter(b, lambda p: regexp_matches(p, '[.;]$')))::BIGINT AS n_punct FROM bullets WHERE len(b) >= 2)"""


@query(f"WITH {_BULLETS} SELECT * FROM marked WHERE n_punct > 0")
def bullet_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of two or more bullets of which one ends in punctuation."""
    return bullet_findings(spark, sf_dir)


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"([A-Z][a-zA-Z]{2,})"), F.lit(1))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.posexplode(words).alias("pos", "token"))


@query(
    """WITH t AS (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Z][a-zA-Z]{2,}')) AS token FROM conversations),
    c AS (SELECT conv_id, token, count(*) AS n FROM t GROUP BY ALL)
    SELECT conv_id, token, n FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, token) = 1"""
)
def dominant_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent capitalised word of each conversation, the least of equals."""
    counts = _tokens(spark, sf_dir).groupBy("conv_id", "token").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("conv_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "token")).alias("b"))
    return best.select("conv_id", "b.token", (-F.col("b.m")).alias("n"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name detector over conversations: deck_id, client_name, score, variants."""
    return A.names_in(_read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("deck_id"), F.struct("turn").alias("place"), "text"))


_WEIGHTED = rf"""w AS (SELECT conv_id, turn, generate_subscripts(l, 1) AS pos, unnest(l) AS token, 0 AS pass, 4 AS weight FROM (SELECT *, regexp_extract_all(text, '\b([A-Z][a-zA-Z]{{2,}})[''’]s\b', 1) AS l FROM conversations)
UNION ALL SELECT conv_id, turn, generate_subscripts(l, 1), unnest(l), 1, 1 FROM (SELECT *, regexp_extract_all(text, '\b[A-Z][a-zA-Z]{{2,}}\b') AS l FROM conversations)),
s AS (SELECT conv_id, token, sum(weight)::BIGINT AS score, min(pass * 1000000000000 + turn * 1000000 + pos) AS place FROM w WHERE upper(token) NOT IN ({", ".join(f"'{x}'" for x in C.STOP_WORDS)}) GROUP BY ALL),
best AS (SELECT conv_id, token, score FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, place) = 1)"""


@query(f"WITH {_WEIGHTED} SELECT * FROM best")
def dominant_token_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client-name detector: weighted counts, stop list, first of equals."""
    return names(spark, sf_dir).select(F.col("deck_id").alias("conv_id"), F.col("client_name").alias("token"), "score")


@query(
    rf"""WITH {_WEIGHTED}, v AS (SELECT conv_id, unnest(regexp_extract_all(text, '\b[A-Z][a-zA-Z]{{2,}} [A-Z][a-zA-Z]+')) AS variant FROM conversations)
    SELECT v.conv_id, v.variant, count(*) AS n FROM v JOIN best b ON v.conv_id = b.conv_id AND split_part(v.variant, ' ', 1) = b.token GROUP BY ALL"""
)
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each capitalised word follows the dominant one."""
    return names(spark, sf_dir).select(F.col("deck_id").alias("conv_id"), F.explode("variants").alias("variant", "n"))


@query(
    rf"""WITH w AS (SELECT source, doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS token, 0 AS pass, 4 AS weight FROM (SELECT *, regexp_extract_all(text, '\b([A-Z][a-zA-Z]{{2,}})[''’]s\b', 1) AS l FROM documents)
    UNION ALL SELECT source, doc_id, generate_subscripts(l, 1), unnest(l), 1, 1 FROM (SELECT *, regexp_extract_all(text, '\b[A-Z][a-zA-Z]{{2,}}\b') AS l FROM documents)),
    s AS (SELECT source, token, sum(weight)::BIGINT AS score, min((pass, doc_id, pos)) AS place FROM w WHERE upper(token) NOT IN ({", ".join(f"'{x}'" for x in C.STOP_WORDS)}) GROUP BY ALL),
    best AS (SELECT source, token FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, place) = 1),
    v AS (SELECT source, unnest(regexp_extract_all(text, '\b[A-Z][a-zA-Z]{{2,}} [A-Z][a-zA-Z]+')) AS variant FROM documents)
    SELECT v.source, v.variant, count(*) AS n FROM v JOIN best b ON v.source = b.source AND split_part(v.variant, ' ', 1) = b.token GROUP BY ALL"""
)
def name_variants_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each capitalised word follows the dominant one of a source's documents."""
    words = _read(spark, sf_dir, "documents").select(F.col("source").alias("deck_id"), F.struct("doc_id").alias("place"), "text")
    return A.names_in(words).select(F.col("deck_id").alias("source"), F.explode("variants").alias("variant", "n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, count(*) AS n, printf('%.2f', (l_partkey * 1000 - l_suppkey * 7000)::DOUBLE / 7) AS moved, printf('%.2f', (l_suppkey * 1000000007)::DOUBLE * 1e6 / 3) AS far FROM lineitem GROUP BY ALL")
def distances_two_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances with two decimals, by their exact values; none of these is a tie."""
    moved, far = (F.col("l_partkey") * 1000 - F.col("l_suppkey") * 7000).cast("double") / 7, (F.col("l_suppkey") * 1_000_000_007).cast("double") * 1e6 / 3
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumns({"moved": S.fixed(moved), "far": S.fixed(far)})


@query(
    """WITH t AS (SELECT role, trim(text, ' ') AS text, conv_id * 100000 + turn AS place FROM conversations),
    c AS (SELECT role, text, count(*) AS n, min(place) AS place FROM t WHERE text <> '' GROUP BY ALL)
    SELECT role, text, n FROM c QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, place) = 1"""
)
def canonical_text_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent text of each role, the first seen of equals."""
    rows = _read(spark, sf_dir, "conversations").select("role", F.trim("text").alias("text"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("place")).where("text <> ''")
    return mode_of(rows, ["role"], "text", "place").select("role", "text", "n")


@query("SELECT conv_id, count(*) AS n_slides FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') = 0")
def missing_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without a system turn."""
    rows = _read(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_slides"), F.count_if(F.col("role") == "system").alias("s")).where("s = 0").drop("s")


@query(
    rf"""WITH w AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_split_to_array(lower(text), '{SPACE}'), lambda x: x <> '')) AS s FROM conversations),
    p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.s, b.s))::BIGINT AS n_shared, len(list_distinct(list_concat(a.s, b.s)))::BIGINT AS n_all
    FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')
    SELECT conv_id, turn, n_shared, n_all, CASE WHEN n_all = 0 THEN 1.0::DOUBLE ELSE n_shared::DOUBLE / n_all END AS likeness FROM p"""
)
def jaccard_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared and all words of a user's turn and the reply, and their likeness."""
    rows = _read(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("s"), (F.col("turn") + 1).alias("next"))
    said = rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("next"), F.col("text").alias("t"))
    s, t = S.word_set(F.col("s")), S.word_set(F.col("t"))
    both = asked.join(said, ["conv_id", "next"])
    return both.select("conv_id", "turn", F.size(F.array_intersect(s, t)).cast("long").alias("n_shared"), F.size(F.array_union(s, t)).cast("long").alias("n_all"), S.jaccard(F.col("s"), F.col("t")).alias("likeness"))


@query(
    rf"""WITH u AS (SELECT conv_id, turn, lower(trim(regexp_replace(translate(string_agg(text, ' ' ORDER BY text), '‘’“”', chr(39) || chr(39) || chr(34) || chr(34)), '{SPACE}', ' ', 'g'), ' ')) AS hay FROM conversations WHERE role = 'user' GROUP BY ALL),
    e AS (SELECT conv_id, turn, lower(regexp_extract(text, '[A-Za-z]{{2,}} [a-z]+')) AS needle FROM conversations WHERE role = 'assistant')
    SELECT e.conv_id, e.turn, contains(hay, needle) AS stands FROM e JOIN u ON u.conv_id = e.conv_id AND u.turn = e.turn - 1 WHERE length(needle) >= 2"""
)
def evidence_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first words that a reply gives as evidence stand in the turn before, its slide."""
    rows = _read(spark, sf_dir, "conversations")
    texts = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("slide"), F.lit(0).alias("shape_pos"), "text")
    said = rows.where("role = 'assistant'").select("conv_id", "turn", (F.col("turn") - 1).alias("slide"), F.regexp_extract("text", r"[A-Za-z]{2,} [a-z]+", 0).alias("evidence"))
    return V.grounded(said, texts, ["conv_id", "slide"]).select("conv_id", "turn", "stands")


@query(
    f"""WITH p AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    r AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in TERMS.items())}) AS r(rule_id, word))
    SELECT doc_id, rule_id, min(line)::BIGINT AS first_line, count(*) AS n_lines FROM p JOIN r ON regexp_matches(p.text, '(^|[^A-Za-z0-9_])' || word || '($|[^A-Za-z0-9_])') GROUP BY ALL"""
)
def term_scan(spark: SparkSession, sf_dir: str, terms: dict[str, str] = TERMS) -> DataFrame:
    """Lines of each document in which a term stands, and the first of them; one pass for all terms."""
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    rules = F.array_compact(F.array(*[F.when(F.col("text").rlike(WORD % w), k) for k, w in terms.items()]))
    return lines.select("doc_id", "line", F.explode(rules).alias("rule_id")).groupBy("doc_id", "rule_id").agg(F.min("line").cast("long").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    place = F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + q
    return rows.select("l_orderkey", place.alias("place"), q.alias("q"), (8 + q % 3).alias("size"), F.concat("l_returnflag", "l_linestatus").alias("fill"), "l_partkey", "l_suppkey")


_CELLS = """cells AS (SELECT l_orderkey, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_quantity::BIGINT AS place,
l_quantity::BIGINT AS q, 8 + l_quantity::BIGINT % 3 AS size, l_returnflag || l_linestatus AS fill, l_partkey, l_suppkey FROM lineitem)"""


@query(
    f"""WITH {_CELLS}, c AS (SELECT l_orderkey, size, count(*) AS n, min(place) AS place FROM cells GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, place) AS r FROM c),
    top AS (SELECT l_orderkey, size AS mode_size FROM m WHERE r = 1 AND total >= 4 AND n >= 0.6 * total)
    SELECT c.l_orderkey, mode_size, c.size, c.n, c.place FROM c JOIN top USING (l_orderkey) WHERE c.size <> mode_size"""
)
def size_mode_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes other than a table's prevailing one (60 % of four cells or more), with their first cell."""
    found = outliers(_cells(spark, sf_dir), ["l_orderkey"], "size", "place", C.MODE_CELLS, C.MODE_SHARE, C.SIZE_TOLERANCE_PT)
    return found.withColumnRenamed("usual", "mode_size")


@query(
    f"""WITH {_CELLS}, c AS (SELECT l_orderkey, fill, count(*) AS n, min(place) AS place, FROM cells GROUP BY ALL)
    SELECT l_orderkey, fill, n, bool_or(fill = 'AF') OVER (PARTITION BY l_orderkey) AS has_stats FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, place) = 1"""
)
def row_fill_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prevailing fill of each table, the first of equals, and whether any cell has the fill of statistics."""
    cells = _cells(spark, sf_dir)
    uses = cells.groupBy("l_orderkey").agg(F.bool_or(F.col("fill") == "AF").alias("has_stats"))
    return mode_of(cells, ["l_orderkey"], "fill", "place").join(uses, "l_orderkey")


@query(f"WITH {_CELLS} SELECT l_orderkey, place, q AS width, coalesce(sum(q) OVER (PARTITION BY l_orderkey ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM cells")
def cell_rect_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each cell begins: the widths of those before it."""
    before = W.partitionBy("l_orderkey").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return _cells(spark, sf_dir).select("l_orderkey", "place", F.col("q").alias("width"), F.coalesce(F.sum("q").over(before), F.lit(0)).alias("x"))


_TABLES = """t AS (SELECT c_custkey AS k, [c_custkey % 50 + 1, c_custkey % 31, c_custkey % 17 + 5, NULL] AS w, [c_custkey % 13 + 2, c_custkey % 7, c_custkey % 29 + 1] AS h FROM customer),
p AS (SELECT k, w, h, r::INT AS r, c::INT AS c, 1 + (k + r) % 3 AS rs, 1 + (k + c) % 3 AS gs FROM t, range(0, 4) a(r), range(0, 5) b(c))"""


@query(
    f"""WITH {_TABLES} SELECT k AS c_custkey, r AS "row", c AS col, CASE WHEN r < 3 AND c < 4 THEN k % 9 + coalesce(list_sum(w[1:c]), 0) END::BIGINT AS x, CASE WHEN r < 3 AND c < 4 THEN k % 5 + coalesce(list_sum(h[1:r]), 0) END::BIGINT AS y,
    CASE WHEN r < 3 AND c < 4 THEN coalesce(list_sum(w[c + 1:c + gs]), 0) END::BIGINT AS cx, CASE WHEN r < 3 AND c < 4 THEN coalesce(list_sum(h[r + 1:r + rs]), 0) END::BIGINT AS cy FROM p"""
)
def cell_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of cells that span rows and columns, in a table for each customer; null outside of the table."""
    k = F.col("c_custkey")
    places = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.struct(r.alias("row"), c.alias("col"))))))
    widths, heights = F.array(k % 50 + 1, k % 31, k % 17 + 5, F.lit(None).cast("long")), F.array(k % 13 + 2, k % 7, k % 29 + 1)
    table = F.struct((k % 9).cast("double").alias("x"), (k % 5).cast("double").alias("y"))
    cells = _read(spark, sf_dir, "customer").select("c_custkey", widths.alias("w"), heights.alias("h"), table.alias("t"), places.alias("p"))
    row, col = F.col("p.row"), F.col("p.col")
    spans = ((1 + (k + n) % 3).cast("int") for n in (row, col))
    rect = S.cell_rect(F.col("t"), F.col("w"), F.col("h"), row, col, *spans)
    return cells.select("c_custkey", "p.row", "p.col", rect.alias("rect")).select("c_custkey", "row", "col", *[F.col(f"rect.{n}").cast("long").alias(n) for n in ("x", "y", "cx", "cy")])


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    colour = F.concat(*[F.lpad(F.hex((k * m) % 256), 2, "0") for m in (37, 101, 53)])
    return _read(spark, sf_dir, "part").select("p_partkey", colour.alias("colour"))


_PALETTE_SQL = ", ".join(f"({i}, '{c}', {int(c[:2], 16)}, {int(c[2:4], 16)}, {int(c[4:], 16)})" for i, c in enumerate(C.PALETTE))
_NEAREST = f"""pal AS (SELECT * FROM (VALUES {_PALETTE_SQL}) AS p(pos, hex, r, g, b)),
rgb AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 101 % 256 AS g, p_partkey * 53 % 256 AS b FROM part),
near AS (SELECT p_partkey, printf('%02X%02X%02X', rgb.r, rgb.g, rgb.b) AS colour, pal.hex AS nearest, ((rgb.r - pal.r) ^ 2 + (rgb.g - pal.g) ^ 2 + (rgb.b - pal.b) ^ 2)::BIGINT AS d2 FROM rgb, pal
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY (rgb.r - pal.r) ^ 2 + (rgb.g - pal.g) ^ 2 + (rgb.b - pal.b) ^ 2, pos) = 1)"""


@query(f"WITH {_NEAREST} SELECT p_partkey, colour, nearest, d2 FROM near")
def nearest_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The palette colour nearest to each part's."""
    rows = _colours(spark, sf_dir)
    near = rows.select("colour").distinct().withColumn("near", S.nearest_colour(F.col("colour")))  # each colour is judged once
    return rows.join(near, "colour", "left").select("p_partkey", "colour", F.col("near.colour").alias("nearest"), F.col("near.d2").cast("long").alias("d2"))


@query(
    f"""WITH {_NEAREST}, off AS (SELECT p_partkey % 97 AS slide, colour, nearest, min(p_partkey) AS first_key FROM near WHERE d2 > {C.COLOUR_TOLERANCE**2} GROUP BY ALL)
    SELECT slide, colour, nearest, first_key FROM off QUALIFY row_number() OVER (PARTITION BY slide ORDER BY first_key) <= {C.COLOURS_PER_SLIDE}"""
)
def off_palette_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four distinct colours of a slide that lie off the palette."""
    rows = _colours(spark, sf_dir).select((F.col("p_partkey") % 97).alias("slide"), "colour", F.col("p_partkey").alias("place"))
    return R.off_palette(rows, ["slide"], [], C.PALETTE).select("slide", "colour", F.col("near.colour").alias("nearest"), F.col("place").alias("first_key"))


#: Rectangles in tenths of an inch.
_RECTS = f"""{_CELLS}, rects AS (SELECT l_orderkey, place, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS pos, l_partkey % 60 AS x, l_suppkey % 40 AS y, 20 + q AS cx, 10 + q % 17 AS cy FROM cells)"""


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("place"))
    tenths = lambda x, name: (x * 91_440).cast("double").alias(name)
    rect = F.struct(tenths(F.col("l_partkey") % 60, "x"), tenths(F.col("l_suppkey") % 40, "y"), tenths(20 + F.col("q"), "cx"), tenths(10 + F.col("q") % 17, "cy"))
    return _cells(spark, sf_dir).select("l_orderkey", pos.alias("pos"), rect.alias("rect"))


@query(
    f"""WITH {_RECTS}, hit AS (SELECT a.l_orderkey, b.pos, greatest(0, least(a.x + a.cx, b.x + b.cx) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.cy, b.y + b.cy) - greatest(a.y, b.y)) AS area, a.cx * a.cy AS whole
    FROM rects a JOIN rects b ON a.l_orderkey = b.l_orderkey AND a.pos = 1 AND b.pos > 1)
    SELECT l_orderkey, pos::BIGINT AS pos, area::BIGINT AS area FROM hit WHERE area * 100 > whole * 45 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) = 1"""
)
def rect_overlap_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first other rectangle that covers over 45 % of a slide's footer."""
    rects = _rects(spark, sf_dir)
    footer = rects.where("pos = 1").select("l_orderkey", F.col("rect").alias("footer"))
    hits = touching(rects.where("pos > 1"), footer, ["l_orderkey"], F.col("rect"), F.col("footer")).where(R.covers(F.col("rect"), F.col("footer")))
    area = F.round(S.overlap_area(F.col("rect"), F.col("footer")) / 91_440**2).cast("long")
    best = hits.groupBy("l_orderkey").agg(F.min(F.struct("pos", area.alias("area"))).alias("b"))
    return best.select("l_orderkey", F.col("b.pos").cast("long").alias("pos"), "b.area")


@query(
    f"""WITH {_RECTS} SELECT a.l_orderkey, a.pos::BIGINT AS pos, b.pos::BIGINT AS above, b.y AS above_y FROM rects a JOIN rects b ON a.l_orderkey = b.l_orderkey AND b.pos <> a.pos AND a.y - b.y - b.cy >= -1 AND a.y - b.y - b.cy < 6
    AND b.x < a.x + a.cx AND a.x < b.x + b.cx AND b.cx * 10 > a.cx * 4 QUALIFY row_number() OVER (PARTITION BY a.l_orderkey, a.pos ORDER BY b.y DESC, b.pos) = 1"""
)
def nearest_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rectangle the nearest one close above it, the first of equals."""
    rects = _rects(spark, sf_dir)
    upper = rects.select("l_orderkey", F.col("pos").alias("b_pos"), F.col("rect").alias("b"))
    near = R.pairs_above(upper, rects, ["l_orderkey"], "b", "rect").where("b_pos <> pos")
    best = near.groupBy("l_orderkey", "pos").agg(F.min(F.struct((-F.col("b.y")).alias("m"), "b_pos")).alias("best"))
    return best.select("l_orderkey", F.col("pos").cast("long").alias("pos"), F.col("best.b_pos").cast("long").alias("above"), F.round(-F.col("best.m") / 91_440).cast("long").alias("above_y"))


@query(
    """WITH a AS (SELECT p_brand, p_size AS anchor FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1)
    SELECT p_partkey, (p_size - anchor)::BIGINT AS moved FROM part JOIN a USING (p_brand) WHERE abs(p_size - anchor) > 12"""
)
def moved_from_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose place differs from their layout's (the brand's first part) by more than 0.12 inches, a hundredth for each size."""
    parts = _read(spark, sf_dir, "part").withColumn("rect", F.struct((F.col("p_size") * 9_144).cast("double").alias("x")))
    anchors = parts.groupBy("p_brand").agg(F.min_by(F.struct("rect", "p_size"), "p_partkey").alias("anchor")).select("p_brand", F.col("anchor.rect").alias("place"), F.col("anchor.p_size").alias("anchor"))
    far = parts.join(anchors, "p_brand").where(R.moved("rect", "place", "x", C.TITLE_MOVED_IN))
    return far.select("p_partkey", (F.col("p_size") - F.col("anchor")).cast("long").alias("moved"))


@query(
    """WITH ph AS (SELECT n_nationkey AS pos, nullif(n_regionkey, 0) AS t, nullif(n_nationkey % 7, 0) AS i FROM nation),
    s AS (SELECT p_partkey, nullif(p_partkey % 6, 0) AS t, nullif(p_partkey % 5, 0) AS i FROM part)
    SELECT p_partkey, CASE WHEN ph.pos IS NULL THEN 4 WHEN s.t IS NOT DISTINCT FROM ph.t AND s.i IS NOT DISTINCT FROM ph.i THEN 1 WHEN s.t IS NOT DISTINCT FROM ph.t THEN 2 ELSE 3 END AS tier, coalesce(ph.pos, -1) AS pos
    FROM s LEFT JOIN ph ON s.t IS NOT DISTINCT FROM ph.t OR (s.i IS NOT NULL AND s.i = ph.i) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY tier, ph.pos) = 1"""
)
def prioritised_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shape's placeholder: by type and index, else by type, else by index; nulls are equal; the first of equals."""
    shapes = _read(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_partkey") % 6, F.lit(0)).alias("t"), F.nullif(F.col("p_partkey") % 5, F.lit(0)).alias("i"))
    places = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.nullif("n_regionkey", F.lit(0)).cast("long").alias("t"), F.nullif(F.col("n_nationkey") % 7, F.lit(0)).cast("long").alias("i"))
    return prioritised(shapes, places, [], "t", "i", "pos").select("p_partkey", F.coalesce("tier", F.lit(4)).alias("tier"), F.coalesce("pos", F.lit(-1)).alias("pos"))


@query(
    """WITH ph AS (SELECT n_regionkey AS layout, n_nationkey AS pos, nullif(n_nationkey % 3, 0) AS t, nullif(n_nationkey % 7, 0) AS i FROM nation),
    s AS (SELECT p_partkey, p_partkey % 7 AS layout, nullif(p_partkey % 4, 0) AS t, nullif(p_partkey % 9, 0) AS i FROM part)
    SELECT p_partkey, coalesce(ph.pos, -1) AS pos FROM s LEFT JOIN ph ON s.layout = ph.layout AND (s.t IS NOT DISTINCT FROM ph.t OR (s.i IS NOT NULL AND s.i = ph.i))
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN ph.pos IS NULL THEN 4 WHEN s.t IS NOT DISTINCT FROM ph.t AND s.i IS NOT DISTINCT FROM ph.i THEN 1 WHEN s.t IS NOT DISTINCT FROM ph.t THEN 2 ELSE 3 END, ph.pos) = 1"""
)
def prioritised_match_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As decks match placeholders: the layout's stand in the shape's row, as an array."""
    nation = _read(spark, sf_dir, "nation")
    holder = F.struct(F.col("n_nationkey").alias("pos"), F.nullif(F.col("n_nationkey") % 3, F.lit(0)).cast("long").alias("ph_type"), F.nullif(F.col("n_nationkey") % 7, F.lit(0)).cast("long").alias("ph_idx"))
    layouts = nation.groupBy(F.col("n_regionkey").cast("long").alias("layout")).agg(F.array_sort(F.collect_list(holder)).alias("places"))
    shapes = _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7).alias("layout"), F.nullif(F.col("p_partkey") % 4, F.lit(0)).alias("t"), F.nullif(F.col("p_partkey") % 9, F.lit(0)).alias("i"))
    best = prioritised_in(F.col("places"), F.col("t"), F.col("i"))
    return shapes.join(layouts, "layout", "left").select("p_partkey", F.coalesce(best["pos"], F.lit(-1)).cast("int").alias("pos"))


@query(
    """SELECT p_partkey, coalesce(CASE WHEN p_partkey % 7 = 1 THEN p_size END, b.size, t.size, CASE WHEN p_partkey % 3 = 0 THEN 12 END, 18)::BIGINT AS size
    FROM part LEFT JOIN (SELECT p_brand, max(p_size) AS size FROM part WHERE p_partkey % 5 = 0 AND p_size > 48 GROUP BY 1) b USING (p_brand)
    LEFT JOIN (SELECT p_type, min(p_size) AS size FROM part WHERE p_size > 49 GROUP BY 1) t USING (p_type)"""
)
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known size of a part's own, its brand's, its type's, and defaults."""
    parts = _read(spark, sf_dir, "part")
    layer = lambda size, name: F.struct(size.cast("long").alias("size")).alias(name)
    brand = parts.where("p_partkey % 5 = 0 and p_size > 48").groupBy("p_brand").agg(layer(F.max("p_size"), "layout"))
    kind = parts.where("p_size > 49").groupBy("p_type").agg(layer(F.min("p_size"), "master"))
    rows = parts.join(brand, "p_brand", "left").join(kind, "p_type", "left")
    rows = rows.select("p_partkey", layer(F.when(F.col("p_partkey") % 7 == 1, F.col("p_size")), "own"), "layout", "master", layer(F.when(F.col("p_partkey") % 3 == 0, 12), "text"), layer(F.lit(18), "default"))
    return coalesced(rows, ["own", "layout", "master", "text", "default"], ["size"])


_SEVERITY = {"title-punct": ("title", "warning", 0.9), "title-lines": ("title", "error", 0.5), "bullet-punct": ("bullets", "info", 0.55)}


def lifted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three rules; a title's shape is its length modulo 3, so that several collapse."""
    titles = title_findings(spark, sf_dir).select("conv_id", "slide_index", "rule_id")
    rows = titles.unionByName(bullet_findings(spark, sf_dir).select("conv_id", "slide_index", F.lit("bullet-punct").alias("rule_id")))
    pick = lambda i: F.coalesce(*[F.when(F.col("rule_id") == k, F.lit(v[i])) for k, v in _SEVERITY.items()])
    return rows.select(F.col("conv_id").alias("deck_id"), (F.col("slide_index") % 3).cast("int").alias("slide_index"), "rule_id", pick(0).alias("category"), pick(1).alias("severity"), (pick(2) + (F.col("slide_index") % 2) * 0.05).alias("confidence"), F.col("slide_index").alias("emit_ord"))


_FINDINGS = f"""{_TITLES}, {_BULLETS},
f AS (SELECT conv_id AS deck_id, (slide_index % 3)::INT AS slide_index, rule_id, CASE rule_id WHEN 'bullet-punct' THEN 'bullets' ELSE 'title' END AS category,
CASE rule_id WHEN 'title-punct' THEN 'warning' WHEN 'title-lines' THEN 'error' ELSE 'info' END AS severity,
CASE rule_id WHEN 'title-punct' THEN 0.9::DOUBLE WHEN 'title-lines' THEN 0.5::DOUBLE ELSE 0.55::DOUBLE END + (slide_index % 2) * 0.05::DOUBLE AS confidence, slide_index AS emit_ord
FROM (SELECT * FROM found UNION ALL SELECT conv_id, slide_index, 'bullet-punct' FROM marked WHERE n_punct > 0)),
m AS (SELECT *, min(emit_ord) OVER (PARTITION BY deck_id, slide_index, rule_id) AS first_ord FROM f QUALIFY row_number() OVER (PARTITION BY deck_id, slide_index, rule_id ORDER BY confidence DESC, emit_ord) = 1)"""


@query(f"WITH {_FINDINGS} SELECT deck_id, slide_index, rule_id, severity, round(confidence, 3) AS confidence, emit_ord, first_ord FROM m")
def collapse_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each slide and rule: the most confident, the first of equals."""
    found = collapse(lifted_findings(spark, sf_dir), ["deck_id", "slide_index", "rule_id"])
    return found.select("deck_id", "slide_index", "rule_id", "severity", F.round("confidence", 3).alias("confidence"), "emit_ord", "first_ord")


@query(
    f"""WITH {_FINDINGS}, a AS (SELECT DISTINCT deck_id, slide_index, category FROM m WHERE rule_id = 'title-punct'),
    s AS (SELECT * FROM m WHERE rule_id = 'title-punct' UNION ALL SELECT m.* FROM m ANTI JOIN a USING (deck_id, slide_index, category) WHERE rule_id <> 'title-punct')
    SELECT deck_id, slide_index, rule_id, row_number() OVER (PARTITION BY deck_id ORDER BY slide_index, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, confidence DESC, emit_ord, rule_id)::BIGINT AS rank FROM s"""
)
def suppress_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that another source has for a slide and category go; the rest are ranked within a deck."""
    found = collapse(lifted_findings(spark, sf_dir), ["deck_id", "slide_index", "rule_id"])
    sure, other = found.where("rule_id = 'title-punct'"), found.where("rule_id <> 'title-punct'")
    rows = sure.unionByName(suppressed(other, sure, ["deck_id", "slide_index", "category"]))
    return ranked(rows).select("deck_id", "slide_index", "rule_id", "rank")


@query(
    f"""WITH {_FINDINGS} SELECT deck_id, count(*) AS n, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
    count(*) FILTER (WHERE severity = 'info') AS infos, count(DISTINCT slide_index) AS slides FROM m GROUP BY deck_id"""
)
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each deck by severity, zeros included, and the slides that have any."""
    return summary(collapse(lifted_findings(spark, sf_dir), ["deck_id", "slide_index", "rule_id"]))


@query(f"WITH {_FINDINGS} SELECT deck_id, slide_index, rule_id FROM m WHERE severity <> 'info' AND confidence >= 0.6")
def primary_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the primary tier."""
    return primary(collapse(lifted_findings(spark, sf_dir), ["deck_id", "slide_index", "rule_id"])).select("deck_id", "slide_index", "rule_id")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, (json_extract(props, '$.k')::BIGINT BETWEEN 0 AND 60) AS valid FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON text, and whether it lies in its range."""
    rows = _read(spark, sf_dir, "events").select("event_id", F.from_json(S.loose_json(F.col("props")), "k bigint").alias("p"))
    return rows.where("p.k is not null").select("event_id", "p.k", F.col("p.k").between(0, 60).alias("valid"))


@query(
    """WITH p AS (SELECT l.doc_id, l.quality = 0 AS expected, contains(d.text, '!!') OR contains(d.text, '$$$') OR contains(d.text, ' | ') AS said, source FROM labels l JOIN documents d USING (doc_id))
    SELECT source, count(*) FILTER (WHERE expected AND said) AS tp, count(*) FILTER (WHERE said) AS found, count(*) FILTER (WHERE expected) AS expected,
    CASE WHEN count(*) FILTER (WHERE expected) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (WHERE expected AND said)::DOUBLE / count(*) FILTER (WHERE expected) END AS recall,
    CASE WHEN count(*) FILTER (WHERE said) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (WHERE expected AND said)::DOUBLE / count(*) FILTER (WHERE said) END AS precision FROM p GROUP BY source"""
)
def eval_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision of a rule against labels, by source; 1 where there is nothing to find."""
    said = F.contains("text", F.lit("!!")) | F.contains("text", F.lit("$$$")) | F.contains("text", F.lit(" | "))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", said.alias("said"))
    rows = docs.join(_read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("expected")), "doc_id")
    counts = rows.groupBy("source").agg(F.count_if(F.col("expected") & F.col("said")).alias("tp"), F.count_if("said").alias("found"), F.count_if("expected").alias("expected"))
    rate = lambda whole: F.when(F.col(whole) == 0, 1.0).otherwise(F.col("tp") / F.col(whole))
    return counts.withColumns({"recall": rate("expected"), "precision": rate("found")})


_REPLACED = rf"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '\bthe\b', 'THE ONE', 'g'), '{SPACE}', ' ', 'g'), ' ')) AS after, regexp_matches(text, '\bthe\b') AS changed FROM documents"


@query(_REPLACED)
def fix_preview_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text after a replacement of a term everywhere, as a digest, and whether it changed. Words end at ASCII letters, digits
    and underscores only; white space is tidied."""
    return _replaced(_read(spark, sf_dir, "documents"))


def _replaced(rows: DataFrame) -> DataFrame:
    after = S.replaced(F.col("text"), WORD % "the", "THE ONE", regex=True)
    return rows.select("doc_id", F.sha2(after, 256).alias("after"), F.col("text").rlike(WORD % "the").alias("changed"))


@query(_REPLACED)
def fix_preview_replace_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fix_preview_replace`` under its former name."""
    return _replaced(_read(spark, sf_dir, "documents"))


#: Titles have room for 153 characters: three lines of 51.
_ROOM = 153
_SHORT = rf"""parts AS (SELECT conv_id, slide_index, title, regexp_split_to_array(regexp_replace(title, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS p FROM titles),
whole AS (SELECT *, list_filter(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], ' ')), lambda x: length(x) <= {_ROOM}) AS fits FROM parts),
cut AS (SELECT *, coalesce(fits[-1], '') AS sentences, left(title, {_ROOM}) AS head FROM whole),
space AS (SELECT *, CASE WHEN strpos(head, ' ') = 0 THEN -1 ELSE length(head) - strpos(reverse(head), ' ') END AS pos FROM cut),
chosen AS (SELECT conv_id, slide_index, title, CASE WHEN length(title) <= {_ROOM} THEN title WHEN sentences <> '' AND length(sentences) >= least(0.5::DOUBLE * {_ROOM}, 0.35::DOUBLE * length(title)) THEN sentences
WHEN pos > 0.6::DOUBLE * {_ROOM} THEN left(head, pos) ELSE head END AS x FROM space)"""


@query(rf"WITH {_TITLES}, {_SHORT} SELECT conv_id, slide_index, title, regexp_replace(trim(x, ' '), '[.,;]+$', '') AS short FROM chosen")
def shorten_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles cut to three lines: whole sentences if enough of the text, else at a space."""
    titles = _turns(spark, sf_dir, "user").withColumn("title", S.one_line(F.col("text")))
    room = S.title_room(F.lit(C.TITLE_WIDTH_IN))
    return titles.select("conv_id", "slide_index", "title", S.shortened(F.col("title"), room).alias("short"))


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings of junk in documents, what labels expect (a layer is a source), and the rule's tag. A slide is a document."""
    docs = _read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "slide_index")
    hits = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(x)), name) for name, x in (("bangs", "!!"), ("dollars", "$$$"), ("bars", " | "))]))
    found = docs.select("slide_index", F.explode(hits).alias("rule_id")).withColumns({"severity": F.lit("warning"), "confidence": F.lit(0.8), "emit_ord": F.lit(0)})
    truth = docs.join(_read(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("slide_index")).distinct(), "slide_index").select("slide_index", F.lit("junk").alias("tag"), F.col("source").alias("layer"))
    tags = spark.createDataFrame([(x, "junk") for x in ("bangs", "dollars", "bars")], "rule_id string, tag string")
    return found, truth, tags


_EVALUATED = """found AS (SELECT doc_id, unnest(list_filter([CASE WHEN contains(text, '!!') THEN 'bangs' END, CASE WHEN contains(text, '$$$') THEN 'dollars' END, CASE WHEN contains(text, ' | ') THEN 'bars' END], lambda x: x IS NOT NULL)) AS rule_id FROM documents),
truth AS (SELECT d.doc_id, d.source AS layer FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)),
hits AS (SELECT truth.*, doc_id IN (SELECT doc_id FROM found) AS hit FROM truth)"""


@query(f"WITH {_EVALUATED} SELECT layer, count(*) FILTER (WHERE hit) AS covered, count(*) AS expected, count(*) FILTER (WHERE hit)::DOUBLE / count(*) AS recall FROM hits GROUP BY layer")
def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of findings by layer."""
    return V.recall(*_evaluated(spark, sf_dir))


@query(f"WITH {_EVALUATED} SELECT doc_id AS slide_index, 'junk' AS tag, layer FROM hits WHERE NOT hit")
def eval_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no finding covers."""
    return V.missed(*_evaluated(spark, sf_dir))


@query(f"WITH {_EVALUATED}, j AS (SELECT doc_id IN (SELECT doc_id FROM truth) AS ok FROM found) SELECT count(*) FILTER (WHERE ok) AS \"right\", count(*) AS total, CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (WHERE ok)::DOUBLE / count(*) END AS precision FROM j")
def eval_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of the primary tier."""
    return V.precision(*_evaluated(spark, sf_dir))


@query(f"WITH {_EVALUATED} SELECT doc_id AS slide_index, rule_id, 0 AS emit_ord FROM found WHERE doc_id NOT IN (SELECT doc_id FROM truth)")
def eval_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary findings that the labels do not expect."""
    return V.false_positives(*_evaluated(spark, sf_dir))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(lifted_findings(spark, sf_dir), ["deck_id", "slide_index", "rule_id"])


@query(
    f"""WITH {_FINDINGS}, s AS (SELECT DISTINCT conv_id AS deck_id, ((turn + 1) % 3)::INT AS slide_index FROM conversations)
    SELECT s.deck_id, s.slide_index, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos, count(rule_id) AS total
    FROM s LEFT JOIN m ON m.deck_id = s.deck_id AND m.slide_index = s.slide_index GROUP BY ALL"""
)
def counts_by_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every slide by severity, zeros included."""
    slides = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("deck_id"), ((F.col("turn") + 1) % 3).cast("int").alias("slide_index")).distinct()
    return V.slide_counts(_merged(spark, sf_dir), slides)


@query(
    f"""WITH {_FINDINGS}, s AS (SELECT DISTINCT conv_id AS deck_id, ((turn + 1) % 3)::INT AS slide_index FROM conversations)
    SELECT s.deck_id, s.slide_index, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos, count(rule_id) AS total,
    count(*) FILTER (WHERE severity <> 'info' AND confidence >= 0.6) AS "primary" FROM s LEFT JOIN m ON m.deck_id = s.deck_id AND m.slide_index = s.slide_index GROUP BY ALL"""
)
def counts_by_slide_and_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``counts_by_slide``, with the findings of the primary tier."""
    slides = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("deck_id"), ((F.col("turn") + 1) % 3).cast("int").alias("slide_index")).distinct()
    return V.slide_counts(_merged(spark, sf_dir), slides, primary_too=True)


def _keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings with the columns of a place, and decisions: titles' punctuation is accepted, bullets' is rejected."""
    none = F.lit(None).cast("string")
    found = _merged(spark, sf_dir).withColumns({"shape_id": none, "row": none, "col": none, "detail": F.col("rule_id"), "evidence": none, "suggestion": none})
    decision = F.when(F.col("rule_id") == "title-punct", "accepted").when(F.col("rule_id") == "bullet-punct", "rejected")
    return found, V.finding_key(found).select("finding_key", decision.alias("decision")).where("decision is not null")


@query(
    f"""WITH {_FINDINGS} SELECT deck_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos, count(*) AS visible,
    count(*) FILTER (WHERE severity IN ('error', 'warning')) AS remaining, count(*) FILTER (WHERE rule_id = 'title-punct') AS accepted, 0::BIGINT AS fixed FROM m GROUP BY deck_id"""
)
def totals_with_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each deck: by severity, still to do, accepted."""
    return V.totals(*_keyed(spark, sf_dir))


@query(f"WITH {_FINDINGS} SELECT deck_id, count(*) AS accepted FROM m WHERE rule_id = 'title-punct' GROUP BY deck_id")
def accepted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks with a report of accepted findings, and how many it holds."""
    report = F.from_json("report", "accepted bigint, accepted_findings array<struct<slide_index:int>>")
    return V.review_report(*_keyed(spark, sf_dir)).select("deck_id", F.size(report["accepted_findings"]).cast("long").alias("accepted"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of titles and bullets in their shapes, without a fix of their own; a reviewer's for long titles."""
    none = F.lit(None).cast("string")
    rows = title_findings(spark, sf_dir).unionByName(bullet_findings(spark, sf_dir).select("conv_id", "slide_index", F.lit("bullet-punct").alias("rule_id")))
    severity = F.when(F.col("rule_id") == "bullet-punct", "info").otherwise("warning")
    named = {"shape_id": F.lit("2"), "row": F.lit(None).cast("int"), "col": F.lit(None).cast("int"), "category": F.lit("title"), "severity": severity, "detail": none, "evidence": none, "suggestion": none, "emit_ord": F.when(F.col("rule_id") == "title-punct", 0).otherwise(1)}
    return rows.withColumnRenamed("conv_id", "deck_id").withColumns(named)


def _with_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    titles = rows.where("role = 'user'").select(F.col("conv_id").alias("deck_id"), (F.col("turn") + 1).alias("slide_index"), S.one_line(F.col("text")).alias("title"))
    footers = rows.groupBy(F.col("conv_id").alias("deck_id")).agg(F.lit(C.CANONICAL_FOOTER).alias("footer"), F.lit(None).cast("struct<x:double,y:double,cx:double,cy:double>").alias("footer_rect"))
    return X.inferred(_placed(spark, sf_dir), titles.dropDuplicates(["deck_id", "slide_index"]), footers, names(spark, sf_dir)).join(titles, ["deck_id", "slide_index"], "left")


_INFERRED = f"""{_TITLES}, {_BULLETS},
fixes AS (SELECT conv_id AS deck_id, slide_index, rule_id, CASE rule_id WHEN 'title-punct' THEN 'title-rewrite' ELSE 'ai-rewrite' END AS kind, title, CASE rule_id WHEN 'title-punct' THEN regexp_replace(title, '[.,;]+$', '') END AS after
FROM found JOIN titles USING (conv_id, slide_index) UNION ALL SELECT conv_id, slide_index, 'bullet-punct', 'text-replace', NULL, NULL FROM marked WHERE n_punct > 0)"""


@query(f"WITH {_INFERRED} SELECT deck_id, slide_index, rule_id, kind, CASE kind WHEN 'text-replace' THEN '' ELSE after END AS replacement FROM fixes")
def inferred_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fix that each finding implies."""
    return _with_inferred(spark, sf_dir).select("deck_id", "slide_index", "rule_id", F.col("inferred.kind").alias("kind"), F.col("inferred.replacement").alias("replacement"))


#: Rules that imply a fix, and one that doesn't.
_IMPLY = ("draft-designator", "confidentiality-modified", "confidentiality-missing", "confidentiality-moved", "font-family", "title-size", "title-bold", "title-punct", "title-lines", "off-palette-color", "table-font-consistency", "table-side-border", "table-statsrow-color", "bullet-punct", "term-percentile", "term-tgt", "term-incumbent", "term-company-name", "confidentiality-overlap")


@query(
    rf"""WITH pal AS (SELECT * FROM (VALUES {_PALETTE_SQL}) AS p(pos, hex, r, g, b)),
    f AS (SELECT o_orderkey AS k, ([{", ".join(f"'{x}'" for x in _IMPLY)}])[o_orderkey % 19 + 1] AS rule, o_orderkey % 60 AS deck, o_orderkey % 5 AS slide, o_orderkey % 4 <> 0 AS placed, o_orderkey % 3 = 0 AS cell, o_orderkey % 7 <> 0 AS said, o_orderkey % 2 = 0 AS sized,
      o_orderkey * 37 % 256 AS r, o_orderkey * 101 % 256 AS g, o_orderkey * 53 % 256 AS b FROM orders),
    near AS (SELECT k, hex FROM f, pal WHERE rule = 'off-palette-color' QUALIFY row_number() OVER (PARTITION BY k ORDER BY (f.r - pal.r) ^ 2 + (f.g - pal.g) ^ 2 + (f.b - pal.b) ^ 2, pos) = 1),
    m AS (SELECT f.*, hex, CASE WHEN rule = 'draft-designator' AND placed AND said THEN 'text-replace' WHEN rule = 'confidentiality-modified' AND placed AND deck % 4 <> 0 THEN 'title-rewrite' WHEN rule = 'confidentiality-missing' AND deck % 4 <> 0 AND deck % 3 <> 0 THEN 'ensure-footer'
      WHEN rule = 'confidentiality-moved' AND placed AND deck % 3 <> 0 THEN 'shape-reposition' WHEN rule = 'font-family' AND placed THEN 'font-family-set' WHEN rule = 'title-size' AND placed THEN 'font-size-set' WHEN rule = 'title-bold' AND placed THEN 'font-bold-set'
      WHEN rule = 'title-punct' AND slide % 3 <> 0 THEN 'title-rewrite' WHEN rule = 'title-lines' AND slide % 3 <> 0 THEN 'ai-rewrite' WHEN rule = 'off-palette-color' AND placed AND said THEN 'color-set' WHEN rule = 'table-font-consistency' AND placed AND cell AND sized THEN 'font-size-set'
      WHEN rule = 'table-side-border' AND placed THEN 'border-remove' WHEN rule = 'table-statsrow-color' AND placed AND cell THEN 'row-fill-set' WHEN rule = 'bullet-punct' AND placed THEN 'text-replace' WHEN rule IN ('term-percentile', 'term-tgt') THEN 'deck-replace'
      WHEN rule IN ('term-incumbent', 'term-company-name') AND placed THEN 'text-replace' END AS kind FROM f LEFT JOIN near USING (k))
    SELECT k AS o_orderkey, rule AS rule_id, kind, CASE WHEN kind IS NULL THEN NULL WHEN rule = 'draft-designator' THEN '{C.DRAFT}' || '\s*' WHEN rule = 'bullet-punct' THEN '[.;]\s*$' WHEN rule = 'off-palette-color' THEN printf('%02X%02X%02X', r, g, b)
      {" ".join(f"WHEN rule = '{t[0]}' THEN '{t[3]}'" for t in C.TERMS)} END AS find,
      CASE WHEN kind IS NULL THEN NULL WHEN rule IN ('draft-designator', 'bullet-punct') THEN '' WHEN rule IN ('confidentiality-modified', 'confidentiality-missing') THEN 'Footer ' || deck WHEN rule = 'font-family' THEN 'Calibri' WHEN rule = 'title-punct' THEN 'Title ' || slide
      {" ".join(f"WHEN rule = '{t[0]}' THEN '{t[4]}'" for t in C.TERMS)} END AS replacement,
      CASE WHEN kind = 'font-size-set' THEN CASE rule WHEN 'title-size' THEN 24.0 ELSE 11.5 END END::DOUBLE AS value, CASE WHEN kind = 'color-set' THEN hex WHEN kind = 'row-fill-set' THEN '{C.STATS_FILL}' END AS color,
      coalesce(kind IN ('ensure-footer', 'shape-reposition'), false) AS placed FROM m"""
)
def implied_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fix that a finding of each rule implies, with and without what it needs: a shape, a cell, a title, a footer, a colour, a size."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    colour = F.concat(F.lit("#"), *[F.lpad(F.hex((k * m) % 256), 2, "0") for m in (37, 101, 53)])
    cell = F.when(k % 3 == 0, 1).cast("int")
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", text(k % 60).alias("deck_id"), (k % 5).cast("int").alias("slide_index"), F.element_at(F.array(*map(F.lit, _IMPLY)), (k % 19 + 1).cast("int")).alias("rule_id"), F.when(k % 4 != 0, "2").alias("shape_id"), cell.alias("row"), cell.alias("col"))
    rows = rows.withColumns({"evidence": F.when(k % 7 != 0, colour), "suggestion": F.when(k % 2 == 0, "Use 11.5 pt").otherwise("Use less")})
    decks = rows.select("deck_id", F.col("deck_id").cast("int").alias("n")).distinct()
    rect = F.struct(*[F.lit(1.0).alias(x) for x in ("x", "y", "cx", "cy")])
    footers = decks.select("deck_id", F.when(F.col("n") % 4 != 0, F.concat(F.lit("Footer "), F.col("deck_id"))).alias("footer"), F.when(F.col("n") % 3 != 0, rect).alias("footer_rect"))
    titles = rows.select("deck_id", "slide_index").distinct().where("slide_index % 3 <> 0").withColumn("title", F.concat(F.lit("Title "), text(F.col("slide_index")), F.lit(".;")))
    out = X.inferred(rows, titles, footers, decks.select("deck_id", F.lit("Globex").alias("client_name"))).select("o_orderkey", "rule_id", "inferred.*")
    return out.select("o_orderkey", "rule_id", "kind", "find", "replacement", "value", "color", F.col("rect").isNotNull().alias("placed"))


@query(f"WITH {_INFERRED} SELECT deck_id, slide_index, rule_id, title AS before, after FROM fixes WHERE kind = 'title-rewrite'")
def fix_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles before and after their fix."""
    rows = _with_inferred(spark, sf_dir).where("inferred.kind = 'title-rewrite'").withColumn("fix", F.col("inferred"))
    return X.preview(rows, "title").select("deck_id", "slide_index", "rule_id", "before", "after")


@query(
    f"""WITH {_TITLES}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY slide_index, CASE rule_id WHEN 'title-punct' THEN 0 ELSE 1 END, rule_id) AS n FROM found)
    SELECT conv_id AS deck_id, ((n - 1) // 3)::INT AS chunk, count(*) AS findings, min(slide_index) AS first_slide FROM r GROUP BY ALL"""
)
def fix_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner's chunks (of three here, for there are few to a deck), with their sizes and first slides."""
    rows = X.chunked(_placed(spark, sf_dir), 3).groupBy("deck_id", "chunk")
    return rows.agg(F.count(F.lit(1)).alias("findings"), F.min("slide_index").alias("first_slide"))
