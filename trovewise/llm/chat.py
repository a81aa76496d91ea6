"""Chat formatting: a finite-state machine over the roles checks the order of turns, a template makes the segments.

A template declares what opens and closes a turn of a role, the transitions between roles, the states in which a
conversation may end, and the roles that are trained on. A valid conversation gives three segments a turn (opening,
body, closing) with a loss flag each: 1 for body and closing of trained roles, else 0. An invalid one gives a single
row with the reason. One shuffle, by conversation.

Defined cases: repeated equal rows count once; a null turn, two different rows of one turn, a null or unknown role,
and an order or an end that the machine doesn't allow make the conversation invalid (the first reason by turn is
given); a null text is an empty body; a null conv_id is a conversation of its own. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    opening: str = "<|{role}|>\n"
    closing: str = "<|end|>\n"
    transitions: frozenset = frozenset({("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")})
    ends: frozenset = frozenset({"assistant"})
    trained: frozenset = frozenset({"assistant"})
    names: dict = field(default_factory=dict, hash=False)

    def opened(self, role: str) -> str:
        return self.opening.replace("{role}", self.names.get(role, role))

    @property
    def roles(self) -> list[str]:
        return sorted({x for pair in self.transitions for x in pair} - {"start"})


def _machine(turns: Column, template: Template) -> Column:
    """The first reason against the sorted turns, null if there is none."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(template.transitions)])

    def step(state: Column, turn: Column) -> Column:
        role = F.coalesce(turn["role"], F.lit("null"))
        reason = (
            F.when(state["reason"].isNotNull(), state["reason"])
            .when(turn["turn"].isNull(), F.lit("a turn is null"))
            .when(turn["turn"] == state["turn"], F.concat(F.lit("turn "), turn["turn"].cast("string"), F.lit(" is repeated")))
            .when(~F.array_contains(allowed, F.concat(state["role"], F.lit(">"), role)), F.concat(role, F.lit(" after "), state["role"]))
        )
        return F.struct(role.alias("role"), turn["turn"].cast("bigint").alias("turn"), reason.alias("reason"))

    start = F.struct(F.lit("start").alias("role"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("reason"))
    last = lambda s: F.when(s["reason"].isNull() & ~s["role"].isin(*sorted(template.ends)), F.concat(F.lit("ends after "), s["role"])).otherwise(s["reason"])
    return F.aggregate(turns, start, step, last)


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, segment, role, text, loss, valid, reason)."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.collect_list(turn)), _order).alias("turns"))
    convs = convs.select("conv_id", "turns", _machine(F.col("turns"), template).alias("reason"))
    opened = F.create_map(*[F.lit(x) for r in template.roles for x in (r, template.opened(r))])

    def three(t: Column) -> Column:
        loss = t["role"].isin(*sorted(template.trained)).cast("int")
        part = lambda text, flag: F.struct(t["role"].alias("role"), text.alias("text"), flag.alias("loss"))
        return F.array(part(opened[t["role"]], F.lit(0)), part(F.coalesce(t["text"], F.lit("")), loss), part(F.lit(template.closing), loss))

    refused = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("loss")))
    parts = F.when(F.col("reason").isNull(), F.flatten(F.transform("turns", three))).otherwise(refused)
    out = convs.select("conv_id", "reason", F.posexplode(parts).alias("segment", "s"))
    return out.select("conv_id", F.col("segment").cast("bigint").alias("segment"), "s.role", "s.text", "s.loss", F.col("reason").isNull().alias("valid"), "reason")


def _order(a: Column, b: Column) -> Column:
    """Turns by number, role and text, null first."""

    def by(name: str, rest: Column) -> Column:
        x, y = a[name], b[name]
        return F.when(x.eqNullSafe(y), rest).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)

    return by("turn", by("role", by("text", F.lit(0))))


def oracle(template: Template = Template()) -> str:
    allowed = ", ".join(f"'{a}>{b}'" for a, b in sorted(template.transitions))
    ends = ", ".join(f"'{x}'" for x in sorted(template.ends))
    trained = ", ".join(f"'{x}'" for x in sorted(template.trained))
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    opened = " ".join(f"WHEN '{r}' THEN {quote(template.opened(r))}" for r in template.roles)
    return f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations
), s AS (
  SELECT *, row_number() OVER w AS i, lag(turn) OVER w AS before, coalesce(lag(coalesce(role, 'null')) OVER w, 'start') AS state,
         lead(1) OVER w IS NULL AS last
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), r AS (
  SELECT *, CASE WHEN turn IS NULL THEN 'a turn is null' WHEN turn = before THEN 'turn ' || turn || ' is repeated'
    WHEN state || '>' || coalesce(role, 'null') NOT IN ({allowed}) THEN coalesce(role, 'null') || ' after ' || state
    WHEN last AND coalesce(role, 'null') NOT IN ({ends}) THEN 'ends after ' || role END AS reason FROM s
), c AS (SELECT conv_id, arg_min(reason, i) FILTER (reason IS NOT NULL) AS reason FROM r GROUP BY conv_id
), k AS (SELECT unnest([0, 1, 2]) AS k)
SELECT r.conv_id, (3 * (i - 1) + k)::BIGINT AS segment, role,
  CASE k WHEN 0 THEN CASE role {opened} END WHEN 1 THEN coalesce(text, '') ELSE {quote(template.closing)} END AS text,
  CASE WHEN k > 0 AND role IN ({trained}) THEN 1 ELSE 0 END AS loss, true AS valid, NULL::VARCHAR AS reason
FROM r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id CROSS JOIN k WHERE c.reason IS NULL
UNION ALL
SELECT conv_id, 0, NULL, NULL, 0, false, reason FROM c WHERE reason IS NOT NULL
"""
