"""The engine's logical tables over the test tables, and the same as common table expressions.

Parts are the catalog (name as title, brand as artist, brand and type as album), orders the sessions, their lines the
turns. Conversations are the dialogues, where the assistant's messages stand for music.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import parse_year
from tessera.operators.turns import history
from tessera.sources.tables import scan
from tessera.store import dealt

FOLDS = 5
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]


def catalog(spark: SparkSession, d: str) -> DataFrame:
    p = scan(spark, d, "part")
    country = F.element_at(F.array(F.lit("US"), F.lit("FR"), F.lit("DE")), (F.col("p_size") % 3 + 1).cast("int"))
    isrc = F.concat(country, F.lit("ABC"), F.lpad((F.col("p_size") * 2 % 100).cast("string"), 2, "0"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    released = F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-06-01"))
    return p.select(
        F.col("p_partkey").alias("track_id"), F.array("p_name").alias("titles"), F.array("p_brand").alias("artists"), F.array(F.concat_ws(" ", "p_brand", "p_type")).alias("albums"),
        F.concat(F.split("p_name", " "), F.array("p_type")).alias("tags"), F.col("p_retailprice").alias("popularity"), (F.col("p_size") * 12000.0).alias("duration"),
        released.alias("release_date"), parse_year(released).alias("year"), isrc.alias("isrc"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(session_id, turn, track_id, fold): the lines of each order in a total order."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
    lines = dealt(scan(spark, d, "lineitem", ["l_orderkey", *_LINE_ORDER]), "l_orderkey")
    return lines.select(F.col("l_orderkey").alias("session_id"), place.alias("turn"), F.col("l_partkey").alias("track_id"), (F.col("l_orderkey") % FOLDS).alias("fold"))


def hist(spark: SparkSession, d: str) -> DataFrame:
    return history(turns(spark, d))


def golds(spark: SparkSession, d: str) -> DataFrame:
    """Rows that have a history, each with its own track as gold; the order's priority is the split."""
    priority = scan(spark, d, "orders", ["o_orderkey", "o_orderstatus"])
    rows = turns(spark, d).filter("turn > 1").select("session_id", "turn", F.col("track_id").alias("gold"))
    return rows.join(priority.withColumnRenamed("o_orderkey", "session_id").withColumnRenamed("o_orderstatus", "split"), "session_id")


def dialogue(spark: SparkSession, d: str) -> DataFrame:
    """(session_id, pos, role, content, turn): a user's and the assistant's message make a turn."""
    role = F.when(F.col("role") == "assistant", "music").otherwise(F.col("role"))
    return scan(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), role.alias("role"), F.col("text").alias("content"), (F.floor(F.col("turn") / 2) + 1).cast("int").alias("turn"))


CTES = {
    "catalog": ([], """SELECT p_partkey AS track_id, [p_name] AS titles, [p_brand] AS artists, [p_brand || ' ' || p_type] AS albums, list_concat(string_split(p_name, ' '), [p_type]) AS tags,
        p_retailprice AS popularity, p_size * 12000.0::DOUBLE AS duration, (p_size + 1950)::VARCHAR || '-06-01' AS release_date, p_size + 1950 AS year,
        (['US', 'FR', 'DE'])[p_size % 3 + 1] || 'ABC' || lpad((p_size * 2 % 100)::VARCHAR, 2, '0') || lpad(p_partkey::VARCHAR, 7, '0') AS isrc, p_name AS title, p_brand AS artist, p_brand || ' ' || p_type AS album FROM part"""),
    "turns": ([], """SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice)::INT AS turn,
        l_partkey AS track_id, l_orderkey % 5 AS fold FROM lineitem"""),
    "hist": (["turns"], "SELECT r.session_id, r.turn, h.turn AS h_turn, h.track_id, r.fold FROM turns r JOIN turns h ON r.session_id = h.session_id AND h.turn < r.turn"),
    "played": (["hist"], "SELECT DISTINCT session_id, turn, track_id FROM hist"),
    "lastp": (["hist"], "SELECT session_id, turn, max_by(track_id, h_turn) AS track_id FROM hist GROUP BY ALL"),
    "golds": (["turns"], "SELECT t.session_id, t.turn, t.track_id AS gold, o.o_orderstatus AS split FROM turns t JOIN orders o ON o.o_orderkey = t.session_id WHERE t.turn > 1"),
    "dialogue": ([], "SELECT conv_id AS session_id, turn AS pos, CASE WHEN role = 'assistant' THEN 'music' ELSE role END AS role, text AS content, (turn // 2 + 1)::INT AS turn FROM conversations"),
    "sets": (["turns"], "SELECT DISTINCT session_id, fold, track_id FROM turns"),
    "cooc": (["sets"], "SELECT a.track_id AS a, b.track_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.session_id = b.session_id AND a.track_id <> b.track_id GROUP BY ALL"),
    "cooc_fold": (["sets"], "SELECT a.track_id AS a, b.track_id AS b, a.fold, count(*) AS n FROM sets a JOIN sets b ON a.session_id = b.session_id AND a.track_id <> b.track_id GROUP BY ALL"),
    "next": (["turns"], "SELECT session_id, turn, fold, track_id AS a, lead(track_id) OVER (PARTITION BY session_id ORDER BY turn) AS b FROM turns"),
    "trans": (["next"], "SELECT a, b, count(*) AS n FROM next WHERE b IS NOT NULL GROUP BY ALL"),
    # candidates by session history, the sources that the union and the evaluation share
    "cooc_top": (["hist", "cooc_fold", "played"], """SELECT session_id, turn, track_id, score, row_number() OVER (PARTITION BY session_id, turn ORDER BY score DESC, track_id) AS rank FROM (
        SELECT h.session_id, h.turn, t.b AS track_id, sum(t.n - coalesce(f.n, 0)) AS score FROM hist h JOIN (SELECT a, b, sum(n) AS n FROM cooc_fold GROUP BY ALL) t ON h.track_id = t.a
        LEFT JOIN cooc_fold f ON f.a = t.a AND f.b = t.b AND f.fold = h.fold GROUP BY ALL) s WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM played p WHERE p.session_id = s.session_id AND p.turn = s.turn AND p.track_id = s.track_id)
        QUALIFY rank <= 20"""),
    "trans_top": (["lastp", "trans", "played"], """SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY score DESC, track_id) AS rank FROM (
        SELECT l.session_id, l.turn, t.b AS track_id, t.n AS score, t.n / sum(t.n) OVER (PARTITION BY l.session_id, l.turn) AS share FROM lastp l JOIN trans t ON l.track_id = t.a) s
        WHERE NOT EXISTS (SELECT 1 FROM played p WHERE p.session_id = s.session_id AND p.turn = s.turn AND p.track_id = s.track_id) QUALIFY rank <= 20"""),
    "album_top": (["hist", "catalog", "played"], """SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY score DESC, track_id) AS rank FROM (
        SELECT h.session_id, h.turn, m.track_id, count(*) AS score FROM (SELECT DISTINCT session_id, turn, album FROM hist JOIN catalog USING (track_id)) h JOIN catalog m ON m.album = h.album GROUP BY ALL) s
        WHERE NOT EXISTS (SELECT 1 FROM played p WHERE p.session_id = s.session_id AND p.turn = s.turn AND p.track_id = s.track_id) QUALIFY rank <= 20"""),
    "long": (["cooc_top", "trans_top", "album_top"], """SELECT session_id, turn, track_id, 'cooc' AS source, 0 AS position, rank, score::DOUBLE AS score FROM cooc_top WHERE rank <= 10 AND score >= 2
        UNION ALL SELECT session_id, turn, track_id, 'transition', 1, rank, score::DOUBLE FROM trans_top
        UNION ALL SELECT session_id, turn, track_id, 'album', 2, rank, score::DOUBLE FROM album_top WHERE rank <= 10"""),
    "ranks": (["golds", "cooc_top"], "SELECT g.session_id, g.turn, g.gold, g.split, count(c.track_id) AS n, min(CASE WHEN c.track_id = g.gold THEN c.rank END) AS rank FROM golds g LEFT JOIN cooc_top c ON c.session_id = g.session_id AND c.turn = g.turn GROUP BY ALL"),
    "disc": (["ranks"], "SELECT *, CASE WHEN rank IS NOT NULL THEN 1.0 / log2(rank + 1) ELSE 0 END AS d FROM ranks"),
}


def sql(names: str, text: str) -> str:
    """A query over some of the expressions, with those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for need in CTES[name][0]:
                add(need)
            order.append(name)

    for n in names.split():
        add(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    if not order:
        return text
    return f"WITH {head},\n{text[5:]}" if text.startswith("WITH ") else f"WITH {head}\n{text}"


def q(expression: str, steps: str = "1e4") -> str:
    """SQL of tessera.functions.text.quantised."""
    return f"(floor(({expression}) * {steps} + 0.5) / {steps})"
