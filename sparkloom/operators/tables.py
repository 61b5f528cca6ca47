"""Changing tables: merge, update and delete as rewrites, slowly changing dimensions, diffs and change feeds, views
kept by increments, constraints, quality checks, masking, retention and audit."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], update: dict[str, Column] | None = None, delete: Column | None = None, insert: bool = True) -> DataFrame:
    """The target after MERGE: matched rows updated (expressions over ``t`` and ``s``) or deleted, new rows inserted.
    A target row that two source rows match is an error."""
    n = F.count("*").over(Window.partitionBy(*keys))  # a null key matches nothing, but its row is inserted
    s = source.select(F.struct(*source.columns).alias("s"), n.alias("_n"), *[F.col(k).alias(f"_s_{k}") for k in keys])
    t = target.select(F.struct(*target.columns).alias("t"), *[F.col(k).alias(f"_t_{k}") for k in keys])
    on = [F.col(f"_t_{k}") == F.col(f"_s_{k}") for k in keys]
    both = t.join(s, on, "full")
    matched = F.col("t").isNotNull() & F.col("s").isNotNull()
    once = F.when(matched & (F.col("_n") > 1), F.raise_error(F.lit("two source rows match a target row")).cast("boolean")).otherwise(F.lit(True))
    both = both.filter(once)
    if delete is not None:
        both = both.filter(~F.coalesce(matched & delete, F.lit(False)))
    if not insert:
        both = both.filter(F.col("t").isNotNull())
    columns = []
    for c in target.columns:
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        changed = (update or {}).get(c, F.col(f"t.{c}"))
        columns.append(F.when(matched, changed).when(F.col("t").isNotNull(), F.col(f"t.{c}")).otherwise(new).alias(c))
    return both.select(*columns)


def update_where(df: DataFrame, condition: Column, assignments: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in assignments.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is null stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change, old, new): inserted, deleted and modified rows, values as structs."""
    values = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*values).alias("old")), new.select(*keys, F.struct(*values).alias("new"))
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").otherwise("modified")
    return a.join(b, list(keys), "full").filter(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, change.alias("change"), "old", "new")


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """Rows with _change_type insert, update_preimage, update_postimage or delete, and _version."""
    d = diff(old, new, keys)
    row = lambda kind, side: F.struct(F.lit(kind).alias("_change_type"), F.col(side).alias("row"))
    each = F.when(F.col("change") == "inserted", F.array(row("insert", "new"))).when(F.col("change") == "deleted", F.array(row("delete", "old")))
    each = each.otherwise(F.array(row("update_preimage", "old"), row("update_postimage", "new")))
    return d.select(*keys, F.explode(each).alias("x")).select(*keys, "x.row.*", "x._change_type", F.lit(version).alias("_version"))


def debezium(feed: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """A change feed as envelopes of before, after, source and op."""
    values = [c for c in feed.columns if not c.startswith("_")]
    body = F.struct(*values)
    op = F.create_map(*[F.lit(x) for p in {"insert": "c", "update_postimage": "u", "delete": "d"}.items() for x in p])[F.col("_change_type")]
    rows = feed.filter("_change_type <> 'update_preimage'")
    envelope = F.struct(
        F.when(F.col("_change_type") == "delete", body).alias("before"), F.when(F.col("_change_type") != "delete", body).alias("after"),
        F.struct(F.lit(source).alias("table"), F.col("_version").alias("version")).alias("source"), op.alias("op"),
    )
    return rows.select(F.to_json(F.struct(*keys)).alias("key"), F.to_json(envelope).alias("value"))


def scd1(dim: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overwrite."""
    return dim.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*dim.columns))


def scd2(dim: DataFrame, new: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: Column, valid_from: str = "valid_from", valid_to: str = "valid_to", current: str = "is_current") -> DataFrame:
    """Close the current row of each key whose tracked columns changed and open a new one; new keys are opened."""
    now, past = dim.filter(F.col(current)), dim.filter(~F.col(current))
    n = new.select(*keys, F.struct(*tracked).alias("_new"))
    both = now.join(n, list(keys), "full")
    changed = F.col("_new").isNotNull() & ~F.struct(*tracked).eqNullSafe(F.col("_new")) & F.col(current).isNotNull()
    kept = both.filter(F.col(current).isNotNull()).withColumns({valid_to: F.when(changed, at).otherwise(F.col(valid_to)), current: ~changed}).select(*dim.columns)
    opened = both.filter(changed | F.col(current).isNull()).select(
        *[F.col(k) if k in keys else F.col(f"_new.{k}").alias(k) if k in tracked else at.alias(k) if k == valid_from else F.lit(None).cast(dim.schema[k].dataType).alias(k) if k == valid_to else F.lit(True).alias(k) if k == current else F.lit(None).cast(dim.schema[k].dataType).alias(k) for k in dim.columns]
    )
    return past.unionByName(kept).unionByName(opened)


def scd3(dim: DataFrame, new: DataFrame, keys: Sequence[str], tracked: Sequence[str], prefix: str = "previous_") -> DataFrame:
    """Keep the value before in a column of its own; a new value may be null."""
    n = new.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in tracked])
    out = dim.join(n, list(keys), "left")
    for c in tracked:
        moved = F.col("_hit").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_n_{c}"))
        out = out.withColumns({f"{prefix}{c}": F.when(moved, F.col(c)).otherwise(F.col(f"{prefix}{c}") if f"{prefix}{c}" in dim.columns else F.lit(None)), c: F.when(moved, F.col(f"_n_{c}")).otherwise(F.col(c))})
    return out.drop("_hit", *[f"_n_{c}" for c in tracked])


def scd4(dim: DataFrame, history: DataFrame | None, new: DataFrame, keys: Sequence[str], at: Column, until: str = "valid_to") -> tuple[DataFrame, DataFrame]:
    """(dimension, history): the dimension is overwritten, and rows that change go to a history table with the time."""
    values = [c for c in dim.columns if c not in keys]
    after = new.select(*keys, F.struct(*values).alias("_new"))
    old = dim.join(after, list(keys)).filter(~F.struct(*values).eqNullSafe(F.col("_new"))).select(*dim.columns, at.alias(until))
    return scd1(dim, new, keys), old if history is None else history.unionByName(old)


def scd6(dim: DataFrame, new: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: Column, current: str = "current_", **names) -> DataFrame:
    """Rows by validity as in type 2, each with the key's current values beside its own, as in types 1 and 3."""
    beside = [f"{current}{c}" for c in tracked]
    rows = scd2(dim.drop(*beside), new, keys, tracked, at, **names)
    now = rows.filter(F.col(names.get("current", "is_current"))).select(*keys, *[F.col(c).alias(b) for c, b in zip(tracked, beside, strict=True)])
    return rows.join(now, list(keys), "left")


def refresh_sums(view: DataFrame, delta: DataFrame, keys: Sequence[str], sums: Sequence[str], sign: str = "_sign") -> DataFrame:
    """A view of counts and sums brought up to date by signed changed rows: only the delta is aggregated."""
    d = delta.groupBy(*keys).agg(F.sum(sign).alias("n"), *[F.sum(F.col(c) * F.col(sign)).alias(c) for c in sums])
    return view.unionByName(d).groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]).filter("n <> 0")


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): a row that both sides changed, and differently, is a conflict."""
    pack = lambda df, n: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(n))
    all_three = pack(base, "b").join(pack(ours, "o"), list(keys), "full").join(pack(theirs, "t"), list(keys), "full")
    ours_changed, theirs_changed = ~F.col("o").eqNullSafe(F.col("b")), ~F.col("t").eqNullSafe(F.col("b"))
    clash = ours_changed & theirs_changed & ~F.col("o").eqNullSafe(F.col("t"))
    merged = all_three.filter(~clash).select(*keys, F.when(theirs_changed, F.col("t")).otherwise(F.col("o")).alias("r")).filter("r IS NOT NULL").select(*keys, "r.*")
    return merged, all_three.filter(clash).select(*keys, "b", "o", "t")


def unmatched_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and names no parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def quality(df: DataFrame, checks: dict[str, tuple]) -> DataFrame:
    """(check, failed, passed): not_null(c), range(c, lo, hi), pattern(c, p), unique(c), row_count(lo, hi); one
    aggregate for all."""
    aggs = []
    for kind, *args in checks.values():
        c = F.col(args[0]) if isinstance(args[0], str) else None
        aggs.append({
            "not_null": lambda: F.count(F.when(c.isNull(), 1)),  # noqa: B023
            "range": lambda: F.count(F.when(~c.between(args[1], args[2]), 1)),  # noqa: B023
            "pattern": lambda: F.count(F.when(~c.rlike(args[1]), 1)),  # noqa: B023
            "unique": lambda: F.count(c) - F.count_distinct(c),  # noqa: B023
            "row_count": lambda: F.when(F.count("*").between(args[0], args[1]), 0).otherwise(1),  # noqa: B023
        }[kind]())
    rows = F.array(*[F.struct(F.lit(n).alias("check"), a.cast("long").alias("failed")) for n, a in zip(checks, aggs, strict=True)])
    return df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.check", "r.failed", (F.col("r.failed") == 0).alias("passed"))


def expect(df: DataFrame, condition: Column, on_violation: str = "drop") -> tuple[DataFrame, DataFrame | None]:
    """(rows, quarantine): fail raises when a row that violates is read, drop and quarantine part them, warn keeps all."""
    bad = ~F.coalesce(condition, F.lit(False))
    if on_violation == "fail":
        return df.filter(F.when(bad, F.raise_error(F.lit("an expectation is violated")).cast("boolean")).otherwise(F.lit(True))), None
    if on_violation == "warn":
        return df, df.filter(bad)
    return df.filter(~bad), df.filter(bad) if on_violation == "quarantine" else None


def mask(c: Column, kind: str, *args) -> Column:
    """email, phone, ssn, credit_card, partial(n), hash, null, redact, bucket(width), partial_mask(first, last, char)."""
    stars = lambda x: F.repeat(F.lit("*"), x)
    if kind == "email":
        return F.regexp_replace(c, r"^(.)[^@]*(@.*)$", "$1***$2")
    if kind == "phone":
        return F.regexp_replace(c, r"[0-9](?=(?:[^0-9]*[0-9]){4})", "*")
    if kind == "ssn":
        return F.concat(F.lit("***-**-"), F.right(c, F.lit(4)))
    if kind == "credit_card":
        return F.concat(stars(F.greatest(F.length(c) - 4, F.lit(0))), F.right(c, F.lit(4)))
    if kind == "partial":
        return F.concat(F.left(c, F.lit(args[0])), stars(F.greatest(F.length(c) - args[0], F.lit(0))))
    if kind == "partial_mask":
        first, last, char = args
        return F.concat(F.left(c, F.lit(first)), F.repeat(F.lit(char), F.greatest(F.length(c) - first - last, F.lit(0))), F.right(c, F.lit(last)))
    if kind == "hash":
        return F.sha2(c.cast("binary"), 256)
    if kind == "bucket":
        return F.floor(c / args[0]) * args[0]
    return {"null": F.lit(""), "redact": F.lit("[REDACTED]")}[kind]


def classify_pii(df: DataFrame, columns: Sequence[str], least: float = 0.5) -> DataFrame:
    """(column, kind, share) of the kinds that at least such a share of a column's values look like."""
    kinds = {"email": r"^[^@\s]+@[^@\s]+\.[a-z]+$", "phone": r"^\+?[0-9() .-]{7,20}$", "ssn": r"^\d{3}-\d{2}-\d{4}$", "credit_card": r"^(?:\d[ -]?){13,19}$", "ip": r"^\d{1,3}(?:\.\d{1,3}){3}$"}
    rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.avg(F.col(c).cast("string").rlike(p).cast("double")).alias("share")) for c in columns for k, p in kinds.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*").filter(F.col("share") >= least)


def audit_chain(df: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str]) -> DataFrame:
    """Each row's digest over its payload and all before it in its key: a change anywhere changes all digests after.
    Rows pass once, sorted by key and order, and only the last key and digest are carried from batch to batch."""
    names = [c for c in df.columns if c != "digest"]
    body = df.select(*names, F.sha2(F.to_json(F.struct(*payload)), 256).alias("digest"), F.to_json(F.struct(*keys)).alias("_key"))

    def chain(frames):
        key, last = None, ""
        for frame in frames:
            out = []
            for k, own in zip(frame["_key"], frame["digest"], strict=True):
                last = hashlib.sha256(((last if k == key else "") + own).encode()).hexdigest()
                key = k
                out.append(last)
            yield frame.drop(columns="_key").assign(digest=out)

    sorted_rows = body.repartition("_key").sortWithinPartitions("_key", order)
    return sorted_rows.mapInPandas(chain, body.drop("_key").schema)


def z_order(df: DataFrame, columns: Sequence[str], partitions: int, bits: int = 8, most: int = 1_000_000) -> DataFrame:
    """Rows dealt out by interleaved bits of the columns' ranks, so files cover small boxes and footers prune. There are
    so many partitions at least, and more where they would have over ``most`` rows; a box of many rows is cut by the
    columns' values."""
    bounds = df.agg(F.count("*").alias("_rows"), *[F.percentile_approx(c, [k / (1 << bits) for k in range(1, 1 << bits)], 10_000).alias(c) for c in columns]).first()
    below = lambda c: F.size(F.filter(F.lit(bounds[c]), lambda e: e <= F.col(c)))
    place = [below(c) for c in columns]
    key = F.lit(0).cast("long")
    for b in range(bits):
        for k, p in enumerate(place):
            key = key.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", p, F.lit(b)).bitwiseAND(F.lit(1)).cast("long"), F.lit(b * len(columns) + k)))
    parts = max(partitions, -(-bounds["_rows"] // most))
    return df.withColumn("_z", key).repartitionByRange(parts, "_z", *columns).sortWithinPartitions("_z").drop("_z")


def retained(df: DataFrame, ts: str, days: int, now: Column, hold: Column | None = None) -> DataFrame:
    """Rows young enough, and those on legal hold."""
    young = F.col(ts) >= now - F.make_interval(days=F.lit(days))
    return df.filter(young | hold if hold is not None else young)


def erase(df: DataFrame, subject: Column, columns: Sequence[str], hold: Column | None = None) -> DataFrame:
    """The subject's values set to null, unless held."""
    hit = subject & ~hold if hold is not None else subject
    return df.withColumns({c: F.when(hit, F.lit(None)).otherwise(F.col(c)) for c in columns})
