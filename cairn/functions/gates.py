"""Electrical tokens of a stem: fixed gates, constraints, wiring, bias, topology."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.binding import let
from cairn.functions.filename import decimal, group_core
from cairn.functions.text import blank_to_null

# Electrical token patterns, all on the lower-cased token.
FIXED_TOP = r"^fixtg=([+-]?(?:\d+(?:[.p]\d+)?))$"
FIXED_TOP_VOLT = r"^fixtg([+-]?(?:\d+(?:[.p]\d+)?))v(?:$|-)"
FIXED_TOP_PREFIX = r"^fixtg=([+-]?(?:\d+(?:[.p]\d+)?))-"
BIAS = r"^vb([+-]?(?:\d+(?:[.p]\d+)?))to([+-]?(?:\d+(?:[.p]\d+)?))$"
TERM = r"[+-]?(?:\d+(?:[.p]\d+)?)?(?:tg|bg1|bg2|bg|cg)"
GATE_AT_END = r"(tg|bg1|bg2|bg|cg)$"
ALL_ZERO = r"^(?:(?:tg|bg1|bg2|bg|cg)=)+(?:tg|bg1|bg2|bg|cg)=0$"

# Spellings of the derived quantities.
TIED = "electrically_tied"
BIAS_SOURCE = "bias_source"
DOPING = "constant_doping"
DISPLACEMENT = "constant_displacement_field"
UNSUPPORTED = "unsupported electrical expression: "
TOPOLOGY_CONFLICT = (
    "both ordinary BG and split BG1/BG2 gates present; back_gate_topology left unset"
)

ELECTRICAL_SCALARS = (
    "fixed_top_gate_V", "active_gate_configuration", "bias_start_V", "bias_stop_V",
    "back_gate_topology",
)

CONSTRAINT_TYPE = (
    "array<struct<raw_expression:string,coefficients:array<struct<gate:string,value:double>>,"
    "control_mode:string,sweep_direction:string>>"
)
CONNECTION_TYPE = (
    "array<struct<raw_expression:string,nodes:array<string>,type:string,source_role:string>>"
)
ELECTRICAL_TYPE = (
    "struct<fixed_top_gate_V:double,active_gate_configuration:string,bias_start_V:double,"
    "bias_stop_V:double,back_gate_topology:string,fixed_gates:array<string>,"
    f"gate_constraints:{CONSTRAINT_TYPE},electrical_connections:{CONNECTION_TYPE},"
    "notes:array<string>>"
)


def _last(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.element_at(items, -1))


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, group))


def _coefficient(term: Column) -> Column:
    text = F.regexp_replace(term, GATE_AT_END, "")
    return F.when(text.isin("", "+"), 1.0).when(text == "-", -1.0).otherwise(decimal(text))


def _total(terms: Column, gate: str) -> Column:
    of_gate = F.filter(terms, lambda t: F.regexp_extract(t, GATE_AT_END, 1) == gate.lower())
    return F.aggregate(of_gate, F.lit(0.0), lambda acc, t: acc + _coefficient(t))


def _coefficients(terms: Column, first: str, second: str) -> Column:
    return F.array(
        F.struct(F.lit(first).alias("gate"), _total(terms, first).alias("value")),
        F.struct(F.lit(second).alias("gate"), _total(terms, second).alias("value")),
    )


def parse_constraint(token: Column) -> Column:
    """One ``=`` token as a linear gate constraint, or null when it is not supported.

    Terms must cover the left side without a gap, so an unknown operator never
    yields a constraint; duplicates of a gate are summed.
    """
    low = F.lower(token)
    left = F.btrim(F.split_part(low, F.lit("="), F.lit(1)))
    right = F.btrim(F.substring(low, F.instr(low, "=") + 1, F.length(low)))
    reverse = right.endswith("rev")
    value = F.when(reverse, F.btrim(F.regexp_replace(right, "rev$", ""))).otherwise(right)

    def from_terms(terms: Column) -> Column:
        gates = F.array_sort(
            F.array_distinct(F.transform(terms, lambda t: F.regexp_extract(t, GATE_AT_END, 1)))
        )
        pair = F.array_join(gates, "+")
        coefficients = F.when(pair == "bg+tg", _coefficients(terms, "BG", "TG")).when(
            pair == "bg1+bg2", _coefficients(terms, "BG1", "BG2")
        )
        covered = F.array_join(terms, "") == left
        return F.when(covered, coefficients)

    def finish(coefficients: Column) -> Column:
        first, second = F.get(coefficients, 0), F.get(coefficients, 1)
        product = F.when(second["gate"] == "TG", first["value"] * second["value"])
        parsed = F.struct(
            token.alias("raw_expression"),
            coefficients.alias("coefficients"),
            F.when(product > 0, DOPING).when(product < 0, DISPLACEMENT).alias("control_mode"),
            F.when(reverse, F.lit("reverse")).alias("sweep_direction"),
        )
        return F.when((value == "0") & coefficients.isNotNull(), parsed)

    return let(let(F.regexp_extract_all(left, F.lit(TERM), F.lit(0)), from_terms), finish)


def _token_kind(token: Column) -> Column:
    """Exactly one class per token; later classes only see what earlier ones left."""
    low = F.lower(token)
    return (
        F.when(low.rlike(FIXED_TOP), "fix")
        .when(low.rlike(FIXED_TOP_VOLT), "fix_volt")
        .when(low.rlike(FIXED_TOP_PREFIX), "fix_prefix")
        .when(low.isin("tgonly", "bg1only"), "active")
        .when(low.rlike(BIAS), "bias")
        .when(low == "bg2-cg", "wire")
        .when(low.rlike(ALL_ZERO), "zero")
        .when(F.contains(low, F.lit("=")), "equation")
    )


def _read_token(token: Column) -> Column:
    return let(
        F.struct(
            _token_kind(token).alias("kind"),
            F.lower(token).alias("low"),
            F.when(F.contains(token, F.lit("=")), parse_constraint(token)).alias("parsed"),
        ),
        lambda bound: _token_record(token, bound["kind"], bound["low"], bound["parsed"]),
    )


def _token_record(token: Column, kind: Column, low: Column, parsed: Column) -> Column:
    constraint = F.when(kind == "equation", parsed)
    rest = F.ltrim(
        F.when(kind == "fix_volt", F.regexp_replace(token, "(?i)" + FIXED_TOP_VOLT, "")).when(
            kind == "fix_prefix", F.regexp_replace(token, "(?i)" + FIXED_TOP_PREFIX, "")
        ),
        F.lit("-"),
    )
    zero_gates = F.split(F.upper(F.regexp_replace(low, "=0$", "")), "=")
    no_gates = F.array().cast("array<string>")
    wire = F.struct(
        token.alias("raw_expression"),
        F.array(F.lit("BG2"), F.lit("CG")).alias("nodes"),
        F.lit(TIED).alias("type"),
        F.lit(BIAS_SOURCE).alias("source_role"),
    )
    gates = (
        F.when(kind.isin("fix", "fix_volt", "fix_prefix") | (low == "tgonly"), F.array(F.lit("TG")))
        .when(low == "bg1only", F.array(F.lit("BG1")))
        .when(kind == "wire", F.array(F.lit("BG2"), F.lit("CG")))
        .when(kind == "zero", zero_gates)
        .when(constraint.isNotNull(), F.transform(parsed["coefficients"], lambda c: c["gate"]))
        .otherwise(no_gates)
    )
    top = (
        F.when(kind == "fix", F.regexp_extract(low, FIXED_TOP, 1))
        .when(kind == "fix_volt", F.regexp_extract(low, FIXED_TOP_VOLT, 1))
        .when(kind == "fix_prefix", F.regexp_extract(low, FIXED_TOP_PREFIX, 1))
    )
    note = F.when((kind == "equation") & parsed.isNull(), F.concat(F.lit(UNSUPPORTED), token)).when(
        F.length(rest) > 0, F.concat(F.lit(UNSUPPORTED), rest)
    )
    return F.struct(
        decimal(top).alias("top_gate"),
        F.when(low == "tgonly", "TG_only").when(low == "bg1only", "BG1_only").alias("active"),
        F.when(kind == "bias", decimal(F.regexp_extract(low, BIAS, 1))).alias("bias_start"),
        F.when(kind == "bias", decimal(F.regexp_extract(low, BIAS, 2))).alias("bias_stop"),
        F.when(kind == "zero", zero_gates).alias("zero_gates"),
        constraint.alias("constraint"),
        F.when(kind == "wire", wire).alias("wire"),
        gates.alias("gates"),
        note.alias("note"),
    )


def topology(gates: Column) -> Column:
    """``split`` or ``single`` back gate; null when neither or both kinds are named."""
    has_split = F.arrays_overlap(gates, F.array(F.lit("BG1"), F.lit("BG2")))
    has_single = F.array_contains(gates, "BG")
    return F.when(has_split & ~has_single, "split").when(has_single & ~has_split, "single")


def read_tokens(stem: Column) -> Column:
    """Array of parsed electrical tokens of a stem, irrelevant tokens dropped.

    Most stems carry none; the cheap pattern test keeps them out of the array work.
    """
    tokens = F.filter(F.split(stem, "_"), lambda t: _token_kind(t).isNotNull())
    return F.when(
        stem.rlike("(?i)fixtg|only|vb|bg2-cg|="), F.transform(tokens, _read_token)
    )


def electrical_struct(tokens: Column) -> Column:
    """Merged electrical description of one stem from ``read_tokens``; null without tokens."""

    def present(field: str) -> Column:
        return F.filter(F.transform(tokens, lambda t: t[field]), lambda v: v.isNotNull())

    def notes(gates: Column) -> Column:
        both = F.arrays_overlap(gates, F.array(F.lit("BG1"), F.lit("BG2"))) & F.array_contains(gates, "BG")
        extra = F.when(both, F.array(F.lit(TOPOLOGY_CONFLICT))).otherwise(F.array().cast("array<string>"))
        return F.concat(present("note"), extra)

    gates = F.flatten(F.transform(tokens, lambda t: t["gates"]))
    built = F.struct(
        _last(present("top_gate")).alias("fixed_top_gate_V"),
        _last(present("active")).alias("active_gate_configuration"),
        _last(present("bias_start")).alias("bias_start_V"),
        _last(present("bias_stop")).alias("bias_stop_V"),
        let(gates, topology).alias("back_gate_topology"),
        F.array_sort(F.array_distinct(F.flatten(present("zero_gates")))).alias("fixed_gates"),
        present("constraint").alias("gate_constraints"),
        present("wire").alias("electrical_connections"),
        let(gates, notes).alias("notes"),
    )
    return F.when(F.size(tokens) > 0, built).otherwise(F.lit(None).cast(ELECTRICAL_TYPE))


def _signless(value: Column) -> Column:
    return F.when(value == 0.0, F.lit("0")).otherwise(value.cast("string"))


def constraint_key(item: Column) -> Column:
    """Order-free spelling of a constraint; the raw expression does not take part."""
    terms = F.array_join(
        F.transform(
            F.array_sort(item["coefficients"]),
            lambda c: F.concat(c["gate"], F.lit("="), _signless(c["value"])),
        ),
        ",",
    )
    return F.concat_ws(
        "|",
        terms,
        F.coalesce(item["control_mode"], F.lit("")),
        F.coalesce(item["sweep_direction"], F.lit("")),
    )


def connection_key(item: Column) -> Column:
    return F.concat_ws("|", F.array_join(item["nodes"], ","), item["type"], item["source_role"])


def electrical_identity(electrical: Column) -> Column:
    """Canonical text of the electrical state, empty when there is none."""

    def part(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value)

    fixed = F.array_join(
        F.transform(electrical["fixed_gates"], lambda g: F.concat(F.lit("fixed="), g, F.lit("=0"))), "|"
    )
    constraints = F.array_join(
        F.array_sort(
            F.transform(
                electrical["gate_constraints"], lambda c: F.concat(F.lit("constraint="), constraint_key(c))
            )
        ),
        "|",
    )
    wires = F.array_join(
        F.array_sort(
            F.transform(
                electrical["electrical_connections"],
                lambda c: F.concat(F.lit("connection="), connection_key(c)),
            )
        ),
        "|",
    )
    text = F.concat_ws(
        "|",
        part("fixtg=", _signless(electrical["fixed_top_gate_V"])),
        part("active=", electrical["active_gate_configuration"]),
        blank_to_null(fixed),
        blank_to_null(constraints),
        blank_to_null(wires),
        part("bias_start=", _signless(electrical["bias_start_V"])),
        part("bias_stop=", _signless(electrical["bias_stop_V"])),
    )
    return F.when(electrical.isNull(), F.lit("")).otherwise(text)


def group_key(norm: Column, electrical: Column) -> Column:
    """Key under which all files of one measurement meet."""
    parts = F.struct(group_core(norm).alias("core"), electrical_identity(electrical).alias("identity"))
    return let(
        parts,
        lambda p: F.when(p["identity"] != "", F.concat(p["core"], F.lit("@"), p["identity"])).otherwise(
            F.coalesce(blank_to_null(p["core"]), norm)
        ),
    )


def electrical_reading(stem: Column) -> Column:
    """Electrical description of a stem, its tokens parsed once."""
    return let(read_tokens(stem), electrical_struct)


def electrical_and_key(stem: Column, norm: Column) -> Column:
    """Struct of ``electrical`` and ``group_key`` of a stem, each part evaluated once."""
    return let(
        read_tokens(stem),
        lambda tokens: let(
            electrical_struct(tokens),
            lambda e: F.struct(e.alias("electrical"), group_key(norm, e).alias("group_key")),
        ),
    )
