"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, or a part of one: lines are also cut behind words whose hash says so, one
in sixteen, so a word put in or taken out changes the paragraphs around it and no others. Its
digest goes into three cells of a table; a cell holds how many digests it took, their
exclusive-or and that of their check values. Subtracting the tables of two versions leaves the digests in which they differ, and
peeling takes them out: a cell of one digest names it, and removing it opens further cells.
If that ends early, the digests are dealt to several tables; those of tables that do not peel
are dealt again with other cells, and what no retry peels is told apart by the digests themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprep.llm.common import parallelism

WORD = r"\S++\s*+"  # and the white space behind it
CUT = 16  # a word in so many ends a paragraph, wherever it stands
THIRD = 32  # cells of each of the three parts of a table
LOAD = 40  # digests that a table is given at a retry
ROUNDS, RETRIES = 24, 8
CELL = "struct<p:int,n:int,k:bigint,h:bigint>"
FULL = 3 * THIRD - 3  # a table of more cells in use has too many digests to peel


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs; none for a null text."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)

    def cut(units: Column) -> Column:
        def digests(hashes: Column) -> Column:
            def ends(i: Column) -> Column:
                own = F.pmod(F.get(hashes, i - 1), F.lit(CUT)) == 0
                return own | F.contains(F.get(units, i - 1), F.lit("\n")) | (i == F.size(hashes))

            def spans(stops: Column) -> Column:
                def digest(stop: Column, j: Column) -> Column:
                    after = F.coalesce(F.get(stops, j - 1), F.lit(0))
                    return F.xxhash64(F.slice(hashes, after + 1, stop - after))

                return F.transform(stops, lambda stop, j: digest(stop, j))

            return _let(F.filter(F.sequence(F.lit(1), F.size(hashes)), ends), spans)

        return _let(F.transform(units, lambda u: F.xxhash64(u)), digests)

    none = F.array().cast("array<bigint>")
    return F.array_distinct(_let(words, lambda units: F.when(F.size(units) > 0, cut(units)).otherwise(none)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _signed(keys: Column, sign: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(sign).alias("n")))


def _entries(keys: Column, n: Column, seed: Column) -> Column:
    """What ``keys``, taken ``n`` times each, add to their three cells, counted from 0."""

    def part(j: int) -> Column:
        def entry(k: Column) -> Column:
            place = F.pmod(F.xxhash64(k, seed, F.lit(j)), F.lit(THIRD)) + j * THIRD
            return F.struct(place.cast("int").alias("p"), n.alias("n"), k.alias("k"), _check(k).alias("h"))

        return F.transform(keys, entry)

    return F.concat(*(part(j) for j in range(3)))


def _of_sign(signed: Column, sign: int) -> Column:
    """The keys among signed digests or cells of one ``n``."""
    return F.transform(F.filter(signed, lambda x: x["n"] == sign), lambda x: x["k"])


def _merged(cells: Column) -> Column:
    """A table: its cells that are not empty, by place, from any number of entries a cell."""

    def runs(s: Column) -> Column:
        def begins(i: Column) -> Column:
            return (i == 1) | (F.get(s, i - 1)["p"] != F.get(s, i - 2)["p"])

        def both(a: Column, b: Column) -> Column:
            return F.struct(
                b["p"].alias("p"), (a["n"] + b["n"]).alias("n"),
                a["k"].bitwiseXOR(b["k"]).alias("k"), a["h"].bitwiseXOR(b["h"]).alias("h"),
            )

        def summed(starts: Column) -> Column:
            def cell(at: Column, j: Column) -> Column:
                end = F.coalesce(F.get(starts, j + 1), F.size(s) + 1)
                first = F.get(s, at - 1)
                # by place: a slice would copy all of the array for every cell
                rest = F.sequence(at, end - 2)
                return F.when(end - at == 1, first).when(end - at == 2, both(first, F.get(s, at))).otherwise(
                    F.aggregate(rest, first, lambda a, i: both(a, F.get(s, i)))
                )

            return F.transform(starts, cell)

        return _let(F.filter(F.sequence(F.lit(1), F.size(s)), begins), summed)

    none = F.array().cast(f"array<{CELL}>")
    whole = _let(F.sort_array(cells), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))
    return F.filter(whole, lambda c: (c["n"] != 0) | (c["k"] != 0))


def sketch(keys: Column) -> Column:
    """The table of a text's digests."""
    return _merged(_entries(keys, F.lit(1), F.lit(0)))


def _filled(signed: Column, seed: Column) -> Column:
    return _merged(F.concat(*(_entries(_of_sign(signed, n), F.lit(n), seed) for n in (1, -1))))


def subtract(left: Column, right: Column) -> Column:
    def minus(c: Column) -> Column:
        return F.struct(c["p"].alias("p"), (-c["n"]).alias("n"), c["k"].alias("k"), c["h"].alias("h"))

    return _merged(F.concat(left, F.transform(right, minus)))


def peel(cells: Column, seed: Column) -> Column:
    """``found`` (``k``, and ``n``: 1 from the left, -1 from the right) and ``left``, the
    number of cells that are not empty at the end."""
    none = F.array().cast("array<struct<k:bigint,n:int>>")
    # with hardly a cell unused there are more digests than cells, and peeling ends early
    state = F.struct(cells.alias("cells"), none.alias("found"), (F.size(cells) <= FULL).alias("going"))

    def is_pure(c: Column) -> Column:
        return F.abs(c["n"]).eqNullSafe(1) & (c["h"] == _check(c["k"]))

    def round_(s: Column, _: Column) -> Column:
        stopped = F.struct(s["cells"].alias("cells"), s["found"].alias("found"), F.lit(False).alias("going"))

        def without(keys: Column) -> Column:
            # a pure cell is empty afterwards, so it and what would be taken out of it are left out
            def kept(c: Column) -> Column:
                return ~F.array_contains(keys["places"], c["p"])

            taken = F.concat(_entries(keys["plus"], F.lit(-1), seed), _entries(keys["minus"], F.lit(1), seed))
            return F.struct(
                _merged(F.concat(F.filter(s["cells"], kept), F.filter(taken, kept))).alias("cells"),
                F.concat(s["found"], _signed(keys["plus"], 1), _signed(keys["minus"], -1)).alias("found"),
                F.lit(True).alias("going"),
            )

        def named(pure: Column) -> Column:
            keys = F.struct(
                F.array_distinct(_of_sign(pure, 1)).alias("plus"),
                F.array_distinct(_of_sign(pure, -1)).alias("minus"),
                F.transform(pure, lambda c: c["p"]).alias("places"),
            )
            return F.when(F.size(pure) == 0, stopped).otherwise(_let(keys, without))

        return F.when(s["going"], _let(F.filter(s["cells"], is_pure), named)).otherwise(s)

    def end(s: Column) -> Column:
        return F.struct(s["found"].alias("found"), F.size(s["cells"]).alias("left"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, state, round_, end)


def _in_tables(signed: Column, tables: Column, seed: Column) -> Column:
    """Deal signed digests to tables by hash, in two steps, and peel each table.

    ``found`` of the tables that peel to the end, ``rest``: all digests of the others, and
    ``left``, the cells that these keep.
    """
    wide = F.ceil(F.sqrt(tables)).cast("long")

    def place(x: Column) -> Column:
        return F.xxhash64(x["k"], seed, F.lit("table"))

    def peeled(mine: Column) -> Column:
        return _let(
            peel(_filled(mine, seed), seed),
            lambda r: F.struct(
                F.filter(r["found"], lambda _: r["left"] == 0).alias("found"),
                F.filter(mine, lambda _: r["left"] > 0).alias("rest"),
                r["left"].alias("left"),
            ),
        )

    def inner(some: Column, w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0).cast("long"), w - 1),
            lambda j: _let(F.filter(some, lambda x: F.pmod(F.shiftright(place(x), 32), w) == j), peeled),
        )

    def outer(w: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0).cast("long"), w - 1),
                lambda i: _let(F.filter(signed, lambda x: F.pmod(place(x), w) == i), lambda some: inner(some, w)),
            )
        )

    return _let(
        _let(wide, outer),
        lambda all_: F.struct(
            F.flatten(F.transform(all_, lambda r: r["found"])).alias("found"),
            F.flatten(F.transform(all_, lambda r: r["rest"])).alias("rest"),
            F.aggregate(all_, F.lit(0), lambda total, r: total + r["left"]).alias("left"),
        ),
    )


def differing(
    left_keys: Column, right_keys: Column, left_sketch: Column, right_sketch: Column
) -> Column:
    """``found`` as in :func:`peel`, always whole, and ``left``, the cells that no retry empties.

    The sketches are tried first. A retry spreads the digests that have not been peeled over
    tables that suit all of them, with other cells each time. Digests that share all three cells
    at every one of :data:`RETRIES` retries are compared themselves.
    """
    first = peel(subtract(left_sketch, right_sketch), F.lit(0))
    signed = F.concat(_signed(left_keys, 1), _signed(right_keys, -1))
    start = _let(
        first,
        lambda r: F.struct(
            F.filter(r["found"], lambda _: r["left"] == 0).alias("found"),
            F.filter(signed, lambda _: r["left"] > 0).alias("rest"),
            r["left"].alias("left"),
        ),
    )

    def retry(state: Column, level: Column) -> Column:
        rest = state["rest"]
        tables = F.greatest(F.lit(1), F.ceil(F.size(rest) / LOAD)) * F.pow(F.lit(2), level - 1).cast("long")
        again = _let(
            _in_tables(rest, tables, level),
            lambda r: F.struct(
                F.concat(state["found"], r["found"]).alias("found"), r["rest"].alias("rest"), r["left"].alias("left")
            ),
        )
        return F.when(state["left"] == 0, state).otherwise(again)

    def whole(state: Column) -> Column:
        left, right = _of_sign(state["rest"], 1), _of_sign(state["rest"], -1)
        return F.struct(
            F.concat(
                state["found"], _signed(F.array_except(left, right), 1), _signed(F.array_except(right, left), -1)
            ).alias("found"),
            state["left"].alias("left"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), start, retry, whole)


def likeness(difference: Column, left_keys: Column, right_keys: Column) -> Column:
    """Share of digests that both sides have, 1 for two texts without paragraphs."""
    total = F.size(left_keys) + F.size(right_keys)
    return F.when(total == 0, 1.0).otherwise(1 - F.size(difference["found"]) / total)


def code(table: Column) -> Column:
    """128 bits of a table as hex."""
    return F.lower(F.concat(*(
        F.lpad(F.hex(F.xxhash64(F.lit(seed), table)), 16, "0") for seed in (1, 2)
    )))


def with_next(docs: DataFrame, id_col: str, columns: list[str], tie: str) -> DataFrame:
    """``docs`` plus ``next_<c>`` of each of ``columns``: those of the row with the next id.

    After the last id comes the first; equal ids are ordered by ``tie``. A row without id
    comes after itself. Rows are dealt to ranges of ids, and the first row of a range goes to
    the range before it as well, so every row meets its successor after one exchange and no
    task orders more than its ranges.
    """
    ranges = 8 * parallelism(docs.sparkSession)
    shares = F.lit(",".join(f"{i / ranges:.9f}" for i in range(ranges)))
    cuts = docs.agg(
        F.min(id_col).alias("least"),
        F.percentile_approx(
            id_col, F.split(shares, ",").cast("array<double>"), max(10_000, 20 * ranges)
        ).alias("cuts"),
    ).first()
    bounds = sorted({cuts["least"], *(cuts["cuts"] or [])} - {None})
    if not bounds:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})

    def literal(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    step = int(len(bounds) ** 0.5) + 1
    key = F.col(id_col)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= key))

    block = (below(literal(bounds[::step])) - 1) * step
    ranged = docs.withColumn("_block", block).withColumn(
        "_inner", F.slice(literal(bounds), F.col("_block") + 1, step)
    )
    own = F.when(key.isNull(), -1 - F.pmod(F.xxhash64(tie), F.lit(ranges))).otherwise(
        F.col("_block") + below(F.col("_inner"))
    )

    def visit(to: Column, guest: int) -> Column:
        return F.struct(to.cast("long").alias("range"), F.lit(guest).alias("guest"))

    visits = F.array_compact(F.array(
        visit(own, 0),
        F.when(F.array_contains("_inner", key), visit(own - 1, 1)),
        F.when(key == bounds[0], visit(F.lit(len(bounds)), 1)),
    ))
    dealt = ranged.filter(key.isNotNull()).select(*docs.columns, F.explode(visits).alias("_v")).unionAll(
        ranged.filter(key.isNull()).select(*docs.columns, visit(own, 0).alias("_v"))
    )
    order = Window.partitionBy("_v.range").orderBy("_v.guest", id_col, tie)

    def following(c: str) -> Column:
        return F.when(key.isNull(), F.col(c)).otherwise(F.lead(c).over(order))

    return (
        dealt.withColumns({f"next_{c}": following(c) for c in columns})
        .filter("_v.guest = 0")
        .drop("_v")
    )


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against an edited text of its own and against the next document's text.

    The edited text has the last half of the code points, rounded down, replaced by as many
    first code points of the next document, or all it has. ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_changed``; ``n_changed`` is
    the number of digests recovered between text and edited text. A null text is empty;
    repeated ids are ordered by a hash of the text; a null id is followed by itself; other
    columns are not read.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumns({"tie": F.xxhash64("text"), "keys": paragraph_digests(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = with_next(texts, "doc_id", ["text", "keys"], "tie").withColumn(
        "edited",
        F.concat(
            F.substring("text", F.lit(1), F.length("text") - half),
            F.substring("next_text", F.lit(1), half),
        ),
    )
    keyed = edited.select(
        "doc_id", "keys", "next_keys",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_digests(F.col("edited")).alias("edited_keys"),
    )
    tables = keyed.withColumns({
        "table": sketch(F.col("keys")),
        "edited_table": sketch(F.col("edited_keys")),
        "next_table": sketch(F.col("next_keys")),
    })
    keys, other, after = F.col("keys"), F.col("edited_keys"), F.col("next_keys")
    compared = tables.withColumns({
        "changed": differing(keys, other, F.col("table"), F.col("edited_table")),
        "moved": differing(keys, after, F.col("table"), F.col("next_table")),
    })
    return compared.select(
        "doc_id", "n_chars", "edited_sha256",
        code(F.col("table")).alias("fingerprint"),
        code(F.col("edited_table")).alias("edited_fingerprint"),
        likeness(F.col("changed"), keys, other).alias("near_edited"),
        likeness(F.col("moved"), keys, after).alias("near_next"),
        F.size("changed.found").cast("long").alias("n_changed"),
    )
