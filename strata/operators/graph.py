"""Who calls what: graded callers, packets of context, unreferenced code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.symbols import address
from strata.plans.relations import Code

#: Decorators that register what they decorate, and names that
#: something outside the tree calls.
REGISTERS = (
    "@abstractmethod @app. @bp. @celery @click @fixture @hookimpl @overload @property @pytest @register @router. "
    "@setter @task @typing.overload").split()
ALWAYS_LIVE = "main setup teardown".split()
TIERS = ("certain", "likely", "possible")
#: Definitions of a name that a packet lists for one call.
MOST_DEFINITIONS = 3
#: Lines of a file in which calls and spans are joined.
STRETCH = 32


def accepts(arity: Column, required: Column, most: Column) -> Column:
    return (required <= arity) & (most.isNull() | (arity <= most))


def homonyms(symbols: DataFrame) -> DataFrame:
    """How many definitions share each name, overloads included."""
    return symbols.groupBy("name").agg(F.count("*").cast("long").alias("homonyms"))


def _targets(code: Code, targets: DataFrame | None) -> DataFrame:
    """The definitions of each address, its class and how many share its name."""
    symbols = code.symbols
    rows = symbols if targets is None else symbols.join(targets.select("path", "dotted").distinct(), ["path", "dotted"], "left_semi")
    parts = F.split("dotted", r"\.")
    target = rows.groupBy("path", "dotted", "name").agg(
        F.array_agg(F.struct("required", "max_args", "start_line", "end_line")).alias("defs")).select(
        F.col("path").alias("t_path"), F.col("dotted").alias("t_dotted"), "name", "defs",
        F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")).alias("t_class"))
    return target.join(homonyms(symbols), "name")


def _calls(code: Code, tests: bool) -> DataFrame:
    calls = code.calls.join(code.files.select("path", "is_test"), "path")
    return calls if tests else calls.where(~F.col("is_test"))


def _imported(code: Code) -> DataFrame:
    return code.imports.select("path", F.explode(F.array_compact(F.array("name", "alias"))).alias("name")).distinct().withColumn(
        "imported", F.lit(True))


def _within_a_definition() -> Column:
    return F.exists("defs", lambda d: F.col("line").between(d["start_line"], d["end_line"]))


def _own() -> Column:
    return F.col("receiver").isin("self", "cls")


def _graded(fits: Column, same_file: Column, same_class: Column) -> tuple[Column, Column]:
    """Tier and reason of a call of a target."""
    unique, own = F.col("homonyms") == 1, _own()
    share = F.concat(F.col("homonyms").cast("string"), F.lit(" definitions share the name"))
    on = F.concat(F.lit("attribute call on `"), "receiver", F.lit("`, "))
    ladder = [
        (~fits, 2, F.concat(F.lit("arity "), F.col("arity").cast("string"), F.lit(" does not fit the signature"))),
        (own & F.coalesce(same_class, F.lit(False)), 0, F.lit("self call inside the class")),
        (own, 2, F.lit("self call in another class")),
        (F.col("receiver").isNotNull() & unique, 1, F.concat(on, F.lit("name unique in repo"))),
        (F.col("receiver").isNotNull(), 2, F.concat(on, share)),
        (same_file & unique, 0, F.lit("bare call in the same file")),
        (same_file, 1, F.concat(F.lit("bare call in the same file, "), share)),
        (F.col("imported") & unique, 0, F.lit("imported by name")),
        (F.col("imported"), 1, F.concat(F.lit("imported by name, "), F.col("homonyms").cast("string"), F.lit(" definitions share it"))),
        (unique, 1, F.lit("bare call, name unique in repo")),
        (F.lit(True), 2, F.concat(F.lit("bare call, "), share))]
    rank = reason = None
    for when, tier, why in ladder:
        when = F.coalesce(when, F.lit(False))
        rank = F.when(when, tier) if rank is None else rank.when(when, tier)
        reason = F.when(when, why) if reason is None else reason.when(when, why)
    return rank, reason


def _tier(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), rank + 1)


def callers(code: Code, targets: DataFrame | None = None, tests: bool = True) -> DataFrame:
    """Graded call sites of each target; targets: path, dotted (all, if absent).

    Calls meet definitions by name.  The definitions of one address are one
    target: its arity fits if any of them accepts it.
    """
    met = _calls(code, tests).join(_targets(code, targets), "name").join(_imported(code), ["path", "name"], "left")
    same_file = F.col("path") == F.col("t_path")
    recursion = same_file & _within_a_definition() & (F.col("enclosing") == F.col("t_dotted")) & F.col("receiver").isNull()
    fits = F.exists("defs", lambda d: accepts(F.col("arity"), d["required"], d["max_args"]))
    same_class = same_file & ((F.col("enclosing") == F.col("t_class")) | F.startswith("enclosing", F.concat("t_class", F.lit("."))))
    rank, reason = _graded(fits, same_file, same_class)
    graded = met.where(~F.coalesce(recursion, F.lit(False))).withColumn("rank", rank)
    return graded.select(
        F.concat("t_path", F.lit("#"), "t_dotted").alias("target"),
        address(F.col("path"), F.col("enclosing"), F.col("line")).alias("address"), "path", "line",
        F.col("full").alias("call"), "arity", _tier(F.col("rank")).alias("confidence"),
        "is_test", reason.alias("reason"), "rank", "byte", "enclosing")


def tier_counts(code: Code, targets: DataFrame | None = None, tests: bool = True) -> DataFrame:
    """How many call sites of how many targets have each tier and reason: what
    ``callers`` gives, counted without its rows.

    A name that many files define and call has as many rows there as the product
    of both.  Here equal calls and equal targets meet once, with their numbers: of
    all files, of the same file, and one by one only of the same class or function.
    """
    found = _targets(code, targets).withColumn("takes", F.array_sort(F.array_distinct(F.transform(
        "defs", lambda d: F.struct(d["required"].alias("required"), d["max_args"].alias("max_args"))))))
    names = found.select("name").distinct()
    calls = _calls(code, tests).join(names, "name", "left_semi").join(
        _imported(code).join(names, "name", "left_semi"), ["path", "name"], "left")
    call, target = ("name", "receiver", "arity", "imported"), ("name", "takes", "homonyms")
    kinds = [*call, *target[1:]]

    def numbers(*place: tuple[str, str]) -> DataFrame:
        here, there = [p for p, _ in place], [F.col(t).alias(p) for p, t in place]
        a = calls.groupBy(*here, *call).agg(F.count("*").alias("a"))
        b = found.select(*there, *target).groupBy(*here, *target).agg(F.count("*").alias("b"))
        return a.join(b, [*here, "name"]).select(*kinds, (F.col("a") * F.col("b")).alias("n"))

    parts = F.split("enclosing", r"\.")
    around = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    inside = calls.where(_own() & F.col("enclosing").isNotNull()).withColumn("_in", F.explode(around)).join(
        found, "name").where((F.col("path") == F.col("t_path")) & (F.col("_in") == F.col("t_class")))
    recursive = calls.where("receiver IS NULL").join(found, "name").where(
        (F.col("path") == F.col("t_path")) & (F.col("enclosing") == F.col("t_dotted")) & _within_a_definition())
    one, everywhere, file = F.lit(1).cast("long").alias("n"), numbers(), numbers(("path", "t_path"))
    n, minus = F.col("n"), -F.col("n")

    def share(rows: DataFrame, weight: Column, same_file: bool, same_class: bool) -> DataFrame:
        return rows.select(*kinds, weight.alias("n"), F.lit(same_file).alias("same_file"), F.lit(same_class).alias("same_class"))

    inside, recursive = inside.select(*kinds, one), recursive.select(*kinds, one)
    pairs = share(everywhere, n, False, False)
    for more in (share(file, minus, False, False), share(file, n, True, False), share(inside, minus, True, False),
                 share(inside, n, True, True), share(recursive, minus, True, False)):
        pairs = pairs.unionByName(more)
    fits = F.exists("takes", lambda d: accepts(F.col("arity"), d["required"], d["max_args"]))
    rank, reason = _graded(fits, F.col("same_file"), F.col("same_class"))
    return pairs.groupBy(_tier(rank).alias("confidence"), reason.alias("reason")).agg(F.sum("n").alias("n")).where("n > 0")


def ordered_callers(rows: DataFrame) -> DataFrame:
    return rows.orderBy("target", "rank", "path", "line", "byte")


def caller_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("target").agg(
        F.count("*").alias("callers"), *[F.count_if(F.col("confidence") == t).alias(t) for t in TIERS],
        F.count_if("is_test").alias("tests"))


def first_definitions(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("path", "dotted").agg(F.min_by("signature", "ord").alias("signature"))


def packet_callers(code: Code, targets: DataFrame, tests: bool = True) -> DataFrame:
    """Signatures of the callers that are certain or likely."""
    rows = callers(code, targets, tests).where("confidence <> 'possible' AND enclosing IS NOT NULL")
    return rows.join(first_definitions(code.symbols).withColumnRenamed("dotted", "enclosing"), ["path", "enclosing"]).select(
        "target", "address", "signature", F.concat("confidence", F.lit(" L"), F.col("line").cast("string")).alias("note"),
        "rank", "path", "line", "byte")


def packet_callees(code: Code, targets: DataFrame) -> DataFrame:
    """What the lines of each target call: up to three definitions of a name."""
    symbols = code.some("symbols", "name", "dotted", "signature", "ord", "start_line", "end_line")
    span = symbols.join(targets.select("path", "dotted").distinct(), ["path", "dotted"]).groupBy("path", "dotted").agg(
        F.min_by(F.struct("start_line", "end_line"), "ord").alias("s"))
    # Paths in order, then source order: the order in which definitions are listed.  The limit
    # and the count are both taken in part before the shuffle, so a name that every file has is small.
    place = Window.partitionBy("name").orderBy("path", "ord")
    first = symbols.select(
        "name", F.concat("path", F.lit("#"), "dotted").alias("address"), "signature",
        F.row_number().over(place).alias("number")).where(F.col("number") <= MOST_DEFINITIONS)
    named = first.join(symbols.groupBy("name").agg(F.count("*").alias("of")), "name")
    calls = code.some("calls", "name", "line")
    # Calls and spans meet in stretches of lines, so a long file is no product of both.
    calls = calls.withColumn("stretch", F.floor(F.col("line") / STRETCH))
    spans = span.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("s.start_line") / STRETCH), F.floor(F.col("s.end_line") / STRETCH))))
    inside = calls.join(spans, ["path", "stretch"]).where(F.col("line").between(F.col("s.start_line"), F.col("s.end_line")))
    wanted = inside.select(F.concat("path", F.lit("#"), "dotted").alias("target"), "name").distinct()
    note = F.when(F.col("of") == 1, "certain").otherwise(F.concat(F.col("of").cast("string"), F.lit(" definitions share this name")))
    return wanted.join(named, "name").groupBy("target", "address").agg(
        F.min(F.struct("number", "signature", note.alias("note"))).alias("r")).select(
        "target", "address", "r.signature", "r.note").orderBy("target", "address")


def packet_types(code: Code, targets: DataFrame) -> DataFrame:
    """Classes that a target's signature names."""
    symbols = code.symbols
    first = symbols.join(targets.select("path", "dotted").distinct(), ["path", "dotted"]).groupBy("path", "dotted").agg(
        F.min_by("type_names", "ord").alias("names"))
    named = first.select(F.concat("path", F.lit("#"), "dotted").alias("target"), F.explode("names").alias("name"))
    classes = symbols.where("kind = 'class'").select("name", F.concat("path", F.lit("#"), "dotted").alias("address"), "signature", "path", "ord")
    return named.join(classes, "name").groupBy("target", "address").agg(
        F.min_by(F.struct("name", "signature"), F.struct("name", "path", "ord")).alias("r")).select(
        "target", "address", "r.signature", F.concat(F.lit("named in the signature as `"), "r.name", F.lit("`")).alias("note")
    ).orderBy("target", "address")


def dead(code: Code) -> DataFrame:
    """Functions and classes that nothing calls, names, exports or registers."""
    symbols, files = code.symbols, code.files
    called = code.calls.select("name").distinct()
    referenced = (
        code.imports.select(F.explode(F.array_compact(F.array("name", "alias"))).alias("name"))
        .unionByName(files.select(F.explode("exports").alias("name")))
        .unionByName(symbols.select(F.explode("type_names").alias("name")))
        .unionByName(symbols.select(F.explode("decorators").alias("d")).select(F.regexp_replace("d", "^@+", "").alias("name")))
        .distinct())
    registered = F.exists("decorators", lambda d: F.array_contains(F.transform(
        F.array(*[F.lit(r) for r in REGISTERS]), lambda r: F.startswith(d, r)), True))
    rows = (
        symbols.where(F.col("kind").isin("function", "class") & ~(F.startswith("name", F.lit("__")) & F.endswith("name", F.lit("__")))
                      & ~F.col("name").isin(ALWAYS_LIVE) & ~registered)
        .join(files.where(~F.col("is_test") & ~F.col("is_package_init")).select("path"), "path", "left_semi")
        .join(called, "name", "left_anti").join(referenced, "name", "left_anti"))
    again = Window.partitionBy("path", "dotted").orderBy("start_line", "ord")
    return rows.withColumn("n", F.row_number().over(again)).where("n = 1").select(
        F.concat("path", F.lit("#"), "dotted").alias("address"), "path", "kind", "signature", "start_line", "end_line",
        (F.col("end_line") - F.col("start_line") + 1).alias("lines")).orderBy("path", "start_line", "address")
