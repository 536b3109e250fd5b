"""Scenario rules, routing and conversation history over tables of queries and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions.text import contains_any, count_present, strip
from clauselake.operators.scale import BLOCK, in_blocks, is_small, number_rows
from clauselake.profiles import STANDARD_ROUTES, STANDARD_TRIAGE, RouteProfile, TriageProfile

# fixed values: history window and titles
HISTORY_TURNS = 6
HISTORY_CHARS = 200
TITLE_CHARS = 24
HARD_EXITS = ("input_empty", "input_too_long", "sensitive", "deprecated")


def deprecated_code(query: Column, p: TriageProfile = STANDARD_TRIAGE) -> Column:
    """First table entry (in table order) named by the code that the coarse pattern finds; else null."""
    raw = F.upper(F.translate(F.regexp_replace(F.regexp_extract(query, p.deprecated_code, 0), r"\s+", ""), "–—", "--"))
    found = F.lit(None).cast("string")
    for code, *_ in reversed(p.deprecated):
        found = F.when(raw.contains(code.upper().replace(" ", "")), code).otherwise(found)
    return found


def is_ambiguous(query: Column, p: TriageProfile = STANDARD_TRIAGE) -> Column:
    """Too little to search for: very short, or of middling length without enough concrete words."""
    n = F.length(query)
    concrete = count_present(query, p.concrete_words)
    return (
        F.when(n < p.very_short, True)
        .when(n <= p.mid_length, (concrete == 0) | (~contains_any(query, p.question_words) & (concrete < 2)))
        .otherwise(False)
    )


def scenario(query: Column, p: TriageProfile = STANDARD_TRIAGE) -> Column:
    """Scenario of a query, the first rule that applies."""
    q = strip(F.coalesce(query, F.lit("")))
    return (
        F.when(q == "", "input_empty")
        .when(F.length(q) > p.max_length, "input_too_long")
        .when(q.rlike(p.sensitive), "sensitive")
        .when(deprecated_code(q, p).isNotNull(), "deprecated")
        .when(q.rlike(p.chitchat), "chitchat")
        .when((F.length(q) <= p.scope_length) & contains_any(F.lower(q), p.out_of_scope), "out_of_scope")
        .when(is_ambiguous(q, p), "ambiguous")
        .otherwise("normal")
    )


def route(query: Column, p: RouteProfile = STANDARD_ROUTES) -> Column:
    """struct(route, reason, matched): tool, decompose or plain; anything unsure is plain."""
    q = strip(F.coalesce(query, F.lit("")))
    code, clause = q.rlike(p.code), q.rlike(p.clause)

    def to(route: str, reason: str, matched: str) -> Column:
        return F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"), F.lit(matched).alias("matched"))

    return (
        F.when(q == "", to("plain", "empty query", ""))
        .when(q.rlike(p.catalog), to("tool", "asks what the corpus holds", "catalog"))
        .when(code & q.rlike(p.status), to("tool", "code and status question", "status"))
        .when(code & clause, to("tool", "code and clause number", "clause_lookup"))
        .when(clause & q.rlike(p.clause_lookup), to("tool", "clause number and original text", "clause_lookup"))
        .when(q.rlike(p.compound), to("decompose", "two points in one question", "compound"))
        .when(
            q.rlike(p.broad),
            F.when(q.rlike(p.specific), to("plain", "sounds broad, asks one value", "broad_but_specific"))
            .otherwise(to("decompose", "asks for all requirements", "broad")),
        )
        .otherwise(to("plain", "ordinary question", ""))
    )


def escalate(routed: DataFrame, verdicts: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows routed as broad take an outside verdict naming single or broad; all others stay."""
    unsure = routed.filter(F.col("matched") == "broad").select(key)
    wanted = verdicts.join(unsure, key, "left_semi").select(key, F.lower(strip(F.col("verdict"))).alias("_v"))
    single, broad = F.col("_v").contains("single"), F.col("_v").contains("broad")
    return routed.join(wanted, key, "left").withColumns(
        {
            "route": F.when(single, "plain").when(broad, "decompose").otherwise(F.col("route")),
            "matched": F.when(single, "verdict_single").when(broad, "verdict_broad").otherwise(F.col("matched")),
        }
    ).drop("_v")


def handled_by(scenario_col: Column, route_col: Column, tool_answered: Column) -> Column:
    """Which step answers: hard exits, then an answering tool, then soft replies, then search."""
    return (
        F.when(scenario_col.isin(*HARD_EXITS), F.concat(F.lit("reply:"), scenario_col))
        .when((route_col == "tool") & tool_answered, "tool")
        .when(scenario_col != "normal", F.concat(F.lit("reply:"), scenario_col))
        .when(route_col == "decompose", "decomposed search")
        .otherwise("search")
    )


def fallback_reply(triaged: DataFrame, replies: DataFrame, p: TriageProfile = STANDARD_TRIAGE) -> DataFrame:
    """Joins the canned reply of the scenario; the one for deprecated codes is filled from the table.

    triaged: (query_id, query, scenario).  replies: (scenario, template), one short row per scenario; the
    template for deprecated codes takes name, code, name, current code and year.
    """
    rows = [
        F.struct(*[F.lit(v).alias(k) for k, v in zip(("code", "current", "name", "year"), entry)])
        for entry in p.deprecated
    ]
    code = deprecated_code(F.col("query"), p)
    info = F.get(F.filter(F.array(*rows), lambda r: r["code"] == code), F.lit(0))
    joined = triaged.join(F.broadcast(replies) if is_small(replies) else replies, "scenario")
    filled = F.format_string(
        "%s", F.replace(
            F.replace(F.replace(F.replace(F.col("template"), F.lit("{name}"), F.coalesce(info["name"], F.lit(""))),
                                F.lit("{code}"), F.coalesce(code, F.lit(""))),
                      F.lit("{current}"), F.coalesce(info["current"], F.lit(""))),
            F.lit("{year}"), F.coalesce(info["year"], F.lit("")),
        ),
    )
    return joined.withColumn("reply", filled).drop("template")


def positions(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", width: int = BLOCK) -> DataFrame:
    """Adds pos, the gapless number of each turn in its conversation."""
    return number_rows(turns, [conv], turn, "pos", width)


def history(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", labels: tuple[str, str] = ("用户", "助手"),
    width: int = BLOCK,
) -> DataFrame:
    """(conv, turn, n_prior, history) at each user turn: the last six finished messages, cut and labelled."""
    finished = turns.filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    blocked = in_blocks(positions(finished, conv, turn, width), [conv], "pos", HISTORY_TURNS, width)
    label = F.when(F.col("role") == "user", labels[0]).otherwise(labels[1])
    line = F.concat(label, F.lit("："), F.substring("text", 1, HISTORY_CHARS))
    w = Window.partitionBy(conv, "_blk").orderBy("pos").rowsBetween(-HISTORY_TURNS, -1)
    lines = blocked.withColumn("_line", line).withColumn("_h", F.collect_list("_line").over(w))
    return lines.filter(~F.col("_copy") & (F.col("role") == "user")).select(
        conv, turn, F.size("_h").alias("n_prior"), F.array_join("_h", "\n").alias("history")
    )


def drop_empty_answers(turns: DataFrame) -> DataFrame:
    """Turns without unfinished (empty) assistant messages."""
    return turns.filter(~((F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) == "")))


def title(text: Column) -> Column:
    """First characters of a question, blanks collapsed."""
    flat = F.regexp_replace(strip(text), r"[ \t\n\r\f\x0b\x{00a0}\x{3000}]+", " ")
    return F.when(F.length(flat) > TITLE_CHARS, F.concat(F.substring(flat, 1, TITLE_CHARS), F.lit("…"))).otherwise(flat)


def titles(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, title, n_messages) of each conversation with a user turn."""
    kept = drop_empty_answers(turns)
    return kept.groupBy(conv).agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col(turn))).alias("_t"),
        F.count("*").alias("n_messages"),
    ).filter(F.col("_t").isNotNull()).select(conv, title(F.col("_t")).alias("title"), "n_messages")


def answer_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", width: int = BLOCK) -> DataFrame:
    """(conv, turn, question, answer): user turns with the turn right after them when the assistant speaks.

    The neighbour is found by joining on its number, so no task holds a conversation.
    """
    numbered = positions(turns, conv, turn, width)
    nxt = numbered.filter(F.col("role") == "assistant").select(
        conv, (F.col("pos") - 1).alias("pos"), F.col("text").alias("answer")
    )
    return numbered.filter(F.col("role") == "user").select(conv, turn, "pos", F.col("text").alias("question")).join(
        nxt, [conv, "pos"], "left"
    ).drop("pos")
