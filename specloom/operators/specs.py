"""Torque tables, inline and staged torques, dimensions: typed lines to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import patterns as P
from specloom.functions.text import comma_number, guess_component, has, line_variants, no_variants, number, part, parts, section_variants, strip
from specloom.operators.structure import in_order, running

VALUES = ["value_nm", "value_lbft", "value_lbin", "value_kgcm", "value_mm", "value_deg"]
SEGMENT_COLUMNS = ["doc_id", "text", "content_type", "section_id", "section_name", "subsection_type", "page_number", "line_number", "component", "spec_value", "vehicle_variant", "stage_number", "is_safety_critical", "has_condition", "confidence", "place"]


def spec_value(raw: Column, **values: Column) -> Column:
    return F.struct(*(values.get(n, F.lit(None)).cast("double").alias(n) for n in VALUES), raw.alias("raw"))


def segment(kind: str, **given: Column) -> list[Column]:
    """The segment columns; ``place`` orders segments of one line as they were found."""
    base = {
        "doc_id": F.col("doc_id"),
        "content_type": F.lit(kind),
        "section_id": F.col("section_id"),
        "section_name": F.col("section_name"),
        "subsection_type": F.col("subsection_type"),
        "page_number": F.col("page_number"),
        "line_number": F.col("idx"),
        "component": F.lit(""),
        "spec_value": F.lit(None).cast("struct<" + ",".join(f"{n}:double" for n in VALUES) + ",raw:string>"),
        "vehicle_variant": no_variants(),
        "stage_number": F.lit(0),
        "is_safety_critical": F.lit(False),
        "has_condition": F.lit(False),
        "confidence": F.lit(1.0),
        "place": F.lit(0),
    }
    return [(base | given)[n].alias(n) for n in SEGMENT_COLUMNS]


def _bracketed(c: Column, template: str) -> Column:
    return F.when(c.isNotNull(), F.format_string(template, c.cast("string")))


def readable(desc: Column, section: Column, nm: Column, lbft: Column, lbin: Column, kgcm: Column | None = None, unit: str = "Nm") -> Column:
    """'Component: d — Torque: n Nm — (n lb-ft) — …': missing parts are left out."""
    said = [F.concat(F.lit("Component: "), desc), _bracketed(nm, f"Torque: %s {unit}")]
    said += [_bracketed(kgcm, "(%s kgf·cm)")] if kgcm is not None else []
    said += [_bracketed(lbft, "(%s lb-ft)"), _bracketed(lbin, "(%s lb-in)"), F.when(section != "", F.concat(F.lit("["), section, F.lit("]")))]
    return F.concat_ws(" — ", *said)


def _in_table(lines: DataFrame, header: Column, units: Column | None = None) -> DataFrame:
    """Lines with the header they stand under as ``_t``, null outside tables."""
    here = F.struct("section_id", "section_name", "subsection_type", "page_number", (units if units is not None else no_variants()).alias("units"), F.lit(True).alias("open"))
    shut = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("section_id", "string"), ("section_name", "string"), ("subsection_type", "string"), ("page_number", "int"), ("units", "array<string>"))), F.lit(False).alias("open"))
    event = F.when(header, here).when(F.col("content_type").isin("section_header", "subsection_header"), shut)
    state = F.last(event, ignorenulls=True).over(running())
    body = ~header & ~F.col("content_type").isin("section_header", "subsection_header")
    return lines.withColumn("_t", F.when(body & state["open"], state))


def _under_header() -> dict[str, Column]:
    return {n: F.col(f"_t.{n}") for n in ("section_id", "section_name", "subsection_type", "page_number")}


def table_rows(lines: DataFrame) -> DataFrame:
    """One segment for each single-line or stacked row under a table header."""
    t = F.col("text")
    after = [F.lead("text", k).over(in_order()) for k in (1, 2, 3)]
    under = _in_table(lines, F.col("content_type") == "table_header").select("*", *(a.alias(f"_n{k}") for k, a in enumerate(after, 1))).filter(F.col("_t").isNotNull())
    one = has(t, P.ROW) & ~has(t, P.NOT_ROW)
    stacked = ~has(t, P.NOT_ROW) & ~has(t, P.VALUE) & has(F.col("_n1"), P.VALUE) & has(F.col("_n2"), P.VALUE) & has(F.col("_n3"), P.VALUE)
    rows = under.withColumn("_one", one).filter(F.col("_one") | F.coalesce(stacked, F.lit(False)))
    pick = lambda k: number(F.when(F.col("_one"), part(t, P.ROW, k + 1)).otherwise(F.col(f"_n{k}")))
    rows = rows.select("*", F.when(F.col("_one"), strip(part(t, P.ROW, 1))).otherwise(t).alias("_desc"), pick(1).alias("_nm"), pick(2).alias("_ft"), pick(3).alias("_in"))
    rows = rows.filter(F.coalesce("_nm", "_ft", "_in").isNotNull())
    raw = F.when(F.col("_one"), t).otherwise(F.concat_ws(" ", t, strip(F.col("_n1")), strip(F.col("_n2")), strip(F.col("_n3"))))
    name = F.col("_t.section_name")
    return rows.select(
        *segment(
            "torque_table_row",
            **_under_header(),
            text=readable(F.col("_desc"), name, F.col("_nm"), F.col("_ft"), F.col("_in")),
            component=F.col("_desc"),
            spec_value=spec_value(raw, value_nm=F.col("_nm"), value_lbft=F.col("_ft"), value_lbin=F.col("_in")),
            vehicle_variant=section_variants(name),
            is_safety_critical=F.lit(True),
            confidence=F.when(F.col("_one"), 0.98).otherwise(0.96),
        )
    )


def staged_torques(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    group = lambda k: part(t, P.STAGE, k)
    value = lambda unit: F.when(group(4) == unit, number(group(3)))
    return lines.filter(has(t, P.STAGE)).select(
        *segment(
            "multi_stage_torque",
            text=t,
            component=guess_component(t),
            spec_value=spec_value(t, value_nm=number(group(2)), value_lbft=value("lb-ft"), value_lbin=value("lb-in")),
            vehicle_variant=line_variants(t),
            stage_number=group(1).cast("int"),
            is_safety_critical=F.lit(True),
            confidence=F.lit(0.96),
        )
    )


def _each(lines: DataFrame, pattern: str, groups: dict[str, int]) -> DataFrame:
    """A row for each match, its groups as columns, ``_k`` its number."""
    found = F.arrays_zip(*(parts(F.col("text"), pattern, g).alias(n) for n, g in groups.items()))
    return lines.filter(has(F.col("text"), pattern)).select("*", F.posexplode(found).alias("_k", "_m")).select("*", *(F.col(f"_m.{n}").alias(n) for n in groups)).drop("_m")


def inline_torques(lines: DataFrame) -> DataFrame:
    """Every 'n Nm (n unit)' of lines that are no stages; a match takes up to 60 characters after it along."""
    t = F.col("text")
    rows = _each(lines.filter(~has(t, P.STAGE)), P.TORQUE, {"_pre": 1, "_nm": 2, "_imp": 3, "_unit": 4, "_post": 5})
    value = lambda unit: F.when(F.col("_unit") == unit, number(F.col("_imp")))
    low = F.lower(t)
    return rows.select(
        *segment(
            "inline_torque",
            text=t,
            component=guess_component(F.concat("_pre", "_post")),
            spec_value=spec_value(t, value_nm=number(F.col("_nm")), value_lbft=value("lb-ft"), value_lbin=value("lb-in")),
            vehicle_variant=line_variants(t),
            is_safety_critical=F.lit(True),
            has_condition=low.contains("condition") | low.contains("when"),
            confidence=F.lit(0.92),
            place=F.col("_k"),
        )
    )


def dimensions(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    rows = _each(lines.filter(~has(t, P.STAGE)), P.DIMENSION, {"_mm": 1})
    return rows.select(*segment("dimensional_spec", text=t, component=guess_component(t), spec_value=spec_value(t, value_mm=number(F.col("_mm"))), vehicle_variant=line_variants(t), confidence=F.lit(0.90), place=F.col("_k") + 1000))


def inline_specs(lines: DataFrame) -> DataFrame:
    return staged_torques(lines).unionByName(inline_torques(lines)).unionByName(dimensions(lines))


# ---- the generic dialect ----


def _units(t: Column) -> Column:
    return parts(t, P.UNIT_TOKEN, 1)


def _mapped(units: Column, cells: list[Column]) -> dict[str, Column]:
    """Cells by the header's units: the last column of a unit counts; Nm and lb-ft by place if no unit is known."""
    plain = F.transform(units, lambda u: F.replace(F.replace(F.lower(u), F.lit("·"), F.lit(".")), F.lit(" "), F.lit("")))
    known: dict[str, Column] = {}
    tests = {
        "value_nm": lambda u: u.contains("n.m") | (u == "nm"),
        "value_kgcm": lambda u: u.contains("kgf"),
        "value_lbft": lambda u: u.contains("lb.ft") | u.contains("ft.lb") | u.contains("lbft"),
        "value_lbin": lambda u: u.contains("lb.in") | u.contains("in.lb") | u.contains("lbin"),
    }
    taken = lambda j, name: F.coalesce(tests[name](F.get(plain, F.lit(j))), F.lit(False))
    names = list(tests)
    for n, name in enumerate(names):
        value = F.lit(None).cast("double")
        for j, cell in enumerate(cells):
            mine = taken(j, name)
            for earlier in names[:n]:
                mine = mine & ~taken(j, earlier)
            value = F.when(mine & cell.isNotNull(), cell).otherwise(value)
        known[name] = value
    none = known["value_nm"].isNull() & known["value_lbft"].isNull() & known["value_kgcm"].isNull()
    return known | {"value_nm": F.when(none, cells[0]).otherwise(known["value_nm"]), "value_lbft": F.when(none, cells[1]).otherwise(known["value_lbft"])}


def _is_value(c: Column) -> Column:
    return F.coalesce(has(F.replace(strip(c), F.lit(","), F.lit("")), P.GENERIC_VALUE), F.lit(False))


def generic_table_rows(lines: DataFrame) -> DataFrame:
    """Rows under any line with two unit tokens or more, their columns mapped by that line's units."""
    t = F.col("text")
    header = F.size(_units(t)) >= 2
    after = [F.lead("text", k).over(in_order()).alias(f"_n{k}") for k in (1, 2, 3)]
    under = _in_table(lines, header, _units(t)).select("*", *after).filter(F.col("_t").isNotNull())
    good = ~has(t, P.GENERIC_NOT_ROW)
    cell = lambda k: number(part(t, P.GENERIC_ROW, k + 1), P.GENERIC)
    n3 = F.when(_is_value(F.col("_n3")), number(F.col("_n3"), P.GENERIC))
    rows = under.select("*", (has(t, P.GENERIC_ROW) & good).alias("_row"), *(cell(k).alias(f"_a{k}") for k in (1, 2, 3)), (good & ~_is_value(t) & _is_value(F.col("_n1")) & _is_value(F.col("_n2"))).alias("_stack"), number(F.col("_n1"), P.GENERIC).alias("_b1"), number(F.col("_n2"), P.GENERIC).alias("_b2"), n3.alias("_b3"))
    blank = F.col("_row") & F.col("_a1").isNull() & F.col("_a2").isNull()
    one = F.col("_row") & ~blank
    stacked = ~F.col("_row") & F.col("_stack") & F.coalesce("_b1", "_b2").isNotNull()
    rows = rows.withColumn("_one", one).filter(one | stacked)
    rows = rows.select("*", F.when(F.col("_one"), strip(part(t, P.GENERIC_ROW, 1))).otherwise(t).alias("_desc"), *(F.when(F.col("_one"), F.col(f"_a{k}")).otherwise(F.col(f"_b{k}")).alias(f"_c{k}") for k in (1, 2, 3)))
    v = _mapped(F.col("_t.units"), [F.col(f"_c{k}") for k in (1, 2, 3)])
    rows = rows.select("*", *(c.alias(f"_{n}") for n, c in v.items()))
    rows = rows.filter(F.coalesce("_value_nm", "_value_lbft", "_value_kgcm").isNotNull())
    name = F.col("_t.section_name")
    return rows.select(
        *segment(
            "torque_table_row",
            **_under_header(),
            text=readable(F.col("_desc"), name, F.col("_value_nm"), F.col("_value_lbft"), F.col("_value_lbin"), F.col("_value_kgcm"), "N·m"),
            component=F.col("_desc"),
            spec_value=spec_value(t, **{n: F.col(f"_{n}") for n in v}),
            is_safety_critical=F.lit(True),
            confidence=F.when(F.col("_one"), 0.97).otherwise(0.95),
        )
    )


def generic_staged_torques(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    group = lambda k: part(t, P.GENERIC_STAGE, k)
    imp, unit = comma_number(group(4)), F.lower(group(5))
    return lines.filter(has(t, P.GENERIC_STAGE)).select(
        *segment(
            "multi_stage_torque",
            text=t,
            component=guess_component(t, P.GENERIC),
            spec_value=spec_value(t, value_nm=comma_number(group(2)), value_lbft=F.when(unit.contains("lb") & ~unit.contains("in"), imp), value_lbin=F.when(unit.contains("in"), imp), value_kgcm=F.when(unit.contains("kgf"), imp)),
            stage_number=group(1).cast("int"),
            is_safety_critical=F.lit(True),
            confidence=F.lit(0.95),
        )
    )


def generic_inline_torques(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    rows = _each(lines.filter(~has(t, P.GENERIC_STAGE)), P.GENERIC_TORQUE, {"_pre": 1, "_nm": 2, "_kg": 4, "_ft": 6, "_lb": 8, "_lbu": 9})
    nm = comma_number(F.split(F.col("_nm"), "[-–]")[0])
    ft, lb, unit = comma_number(F.col("_ft")), comma_number(F.col("_lb")), F.lower("_lbu")
    low = F.lower(t)
    return rows.withColumn("_value", nm).filter("_value > 0").select(
        *segment(
            "inline_torque",
            text=t,
            component=guess_component(F.col("_pre"), P.GENERIC),
            spec_value=spec_value(t, value_nm=F.col("_value"), value_kgcm=comma_number(F.col("_kg")), value_lbft=F.coalesce(ft, F.when(unit.contains("ft") & ~unit.contains("in"), lb)), value_lbin=F.when(ft.isNull() & unit.contains("in"), lb)),
            is_safety_critical=F.lit(True),
            has_condition=low.contains("when") | low.contains("if "),
            confidence=F.lit(0.90),
            place=F.col("_k"),
        )
    )


def generic_dimensions(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    rows = _each(lines.filter(~has(t, P.GENERIC_STAGE)), P.DIMENSION, {"_mm": 1}).withColumn("_value", comma_number(F.col("_mm"))).filter("_value != 0")
    return rows.select(*segment("dimensional_spec", text=t, component=guess_component(t, P.GENERIC), spec_value=spec_value(t, value_mm=F.col("_value")), confidence=F.lit(0.88), place=F.col("_k") + 1000))


def generic_inline_specs(lines: DataFrame) -> DataFrame:
    return generic_staged_torques(lines).unionByName(generic_inline_torques(lines)).unionByName(generic_dimensions(lines))


def _cell_of(test, earlier: list):
    """A condition on (header, cell): a number under a header that meets ``test`` and none of the tests before it."""

    def mine(x: Column) -> Column:
        ok = test(x["h"]) & x["c"].rlike(r"^[0-9]*\.?[0-9]+$|^[0-9]+\.$")
        for other in earlier:
            ok = ok & ~other(x["h"])
        return ok

    return mine


def coordinate_rows(tables: DataFrame) -> DataFrame:
    """Torque rows of tables found by position: (doc_id, page, rows array<array<string>>), header in row 0.

    A table of one row is header and data at once. Tables without a torque unit in any cell give nothing.
    """
    torque = F.exists(F.flatten("rows"), lambda c: has(c, P.TABLE_CELL_UNIT))
    data = F.when(F.size("rows") > 1, F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1)))).otherwise(F.col("rows"))
    rows = tables.filter(F.size("rows") > 0).filter(torque).select("doc_id", "page", F.col("rows")[0].alias("head"), F.posexplode(data).alias("k", "row"))
    rows = rows.filter(F.exists("row", lambda c: strip(c) != ""))
    cells = F.transform(F.zip_with("head", "row", lambda h, c: F.struct(h.alias("h"), c.alias("c"))), lambda x: F.struct(F.lower(x["h"]).alias("h"), F.replace(strip(x["c"]), F.lit(","), F.lit("")).alias("c")))
    rows = rows.withColumn("cells", F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1))))
    tests = {
        "value_nm": lambda h: h.contains("n·m") | h.contains("n.m") | (h == "nm"),
        "value_kgcm": lambda h: h.contains("kgf"),
        "value_lbft": lambda h: h.contains("lb-ft") | h.contains("ft-lb") | h.contains("ft·lbf"),
        "value_lbin": lambda h: h.contains("lb-in") | h.contains("in-lb"),
    }
    values: dict[str, Column] = {}
    names = list(tests)
    for n, name in enumerate(names):
        values[name] = F.try_element_at(F.filter("cells", _cell_of(tests[name], [tests[e] for e in names[:n]])), F.lit(-1))["c"].try_cast("double")
    found = F.coalesce(values["value_nm"], values["value_lbft"], values["value_kgcm"]).isNotNull()
    text = F.array_join(F.transform("row", lambda c: F.when(c == "", F.lit("—")).otherwise(c)), " | ")
    flat = rows.select("doc_id", "page", "k", F.col("row"), text.alias("text"), found.alias("found"), *(v.alias(n) for n, v in values.items()))
    blank = {n: F.lit("") for n in ("section_id", "section_name", "subsection_type")}
    sv = F.when(F.col("found"), spec_value(F.array_join("row", " | "), **{n: F.col(n) for n in values}))
    return flat.select(*segment("torque_table_row", **blank, text=F.col("text"), page_number=F.col("page"), line_number=F.lit(0), component=strip(F.col("row")[0]), spec_value=sv, is_safety_critical=F.lit(True), confidence=F.lit(0.90), place=F.col("k")))
