"""Identity-reuse features: who shares devices, addresses, phones, instruments, IP prefixes.

Counting *distinct other accounts* needs no pair list for crowded entities. An entity with
more than ``hot_accounts`` users is "hot". Pairs are formed only inside the other entities
(at most ``hot_accounts`` partners per row). For hot entities each account carries the set
of hot entities it uses; accounts with equal sets are counted once per set, and a pair found
through a quiet entity is skipped when the two sets already overlap. The result is exact for
any threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.constants import ENTITY_SHORT, IP_WINDOW_US
from verdigris.functions.exprs import micros
from verdigris.operators.bandjoin import met_once
from verdigris.session import materialize

HOT_ACCOUNTS = 10_000
CELL = 1_024
KINDS = list(ENTITY_SHORT.values())


def entity_links(orders: DataFrame) -> DataFrame:
    """Distinct (kind, entity, account), long form."""
    items = F.array(
        *[
            F.struct(F.lit(short).alias("kind"), F.col(c).cast("string").alias("entity"))
            for c, short in ENTITY_SHORT.items()
        ]
    )
    return (
        orders.select("account_id", F.explode(items).alias("e"))
        .select("e.kind", "e.entity", "account_id")
        .filter(F.col("entity").isNotNull())
        .distinct()
    )


def sized_links(links: DataFrame) -> DataFrame:
    """Every link with the number of users of its entity."""
    sizes = links.groupBy("kind", "entity").agg(F.count("*").alias("users"))
    return links.join(sizes, ["kind", "entity"])


def stored_links(orders: DataFrame) -> DataFrame:
    """Sized links written once; four feature blocks read them."""
    return materialize(sized_links(entity_links(orders)), "links")


def accounts_per_entity(sized: DataFrame) -> DataFrame:
    """Mean number of users over the account's entities, per kind; self included."""
    return (
        sized.groupBy("account_id")
        .agg(
            *[
                F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("users"))), F.lit(0.0)).alias(
                    f"accounts_per_{k}"
                )
                for k in KINDS
            ]
        )
    )


def _hot_sets(sized: DataFrame, hot_accounts: int) -> DataFrame:
    """Account -> one array of hot entities per kind (empty when none)."""
    empty = F.array().cast("array<string>")
    return (
        sized.filter(F.col("users") > hot_accounts)
        .groupBy("account_id")
        .agg(
            *[
                F.coalesce(
                    F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("entity")))), empty
                ).alias(f"hot_{k}")
                for k in KINDS
            ]
        )
    )


def _grid(quiet: DataFrame, mine: list[F.Column], other: list[F.Column]) -> DataFrame:
    """All (a, b) of the users of each entity; entities of more than CELL users in cells of CELL x CELL."""
    slices = F.ceil(F.col("users") / F.lit(CELL)).cast("int")
    place = F.pmod(F.xxhash64("account_id"), slices).cast("int")
    every = F.explode(F.sequence(F.lit(0), slices - 1))
    left = quiet.select("kind", "entity", F.col("account_id").alias("a"), *mine, place.alias("row"), every.alias("col"))
    right = quiet.select("kind", "entity", F.col("account_id").alias("b"), *other, place.alias("col"), every.alias("row"))
    return left.join(right, ["kind", "entity", "row", "col"])


def _bits(kinds: str) -> dict[str, F.Column]:
    """One flag per kind from a number with a bit for each."""
    return {f"quiet_{k}": F.col(kinds).bitwiseAND(1 << i) != 0 for i, k in enumerate(KINDS)}


def _kind_bit() -> F.Column:
    bit = F.lit(None).cast("int")
    for i, k in enumerate(KINDS):
        bit = F.when(F.col("kind") == k, F.lit(1 << i)).otherwise(bit)
    return bit


def _pairs_without_hot(quiet: DataFrame) -> DataFrame:
    return (
        _grid(quiet, [], [])
        .filter(F.col("a") < F.col("b"))
        .groupBy("a", "b")
        .agg(F.bit_or(_kind_bit()).alias("kinds"))
        .withColumns(_bits("kinds"))
        .withColumns({f"both_{k}": F.lit(False) for k in KINDS})
        .drop("kinds")
    )


def _quiet_pairs(sized: DataFrame, hot: DataFrame, hot_accounts: int) -> DataFrame:
    """Pairs a < b met through quiet entities: flags per kind, seen quietly and seen hot, the same for both."""
    empty = F.array().cast("array<string>")
    quiet = sized.filter(F.col("users").between(2, hot_accounts))
    if hot is None:
        return _pairs_without_hot(quiet)
    quiet = quiet.join(hot, "account_id", "left").select(
        "kind", "entity", "account_id", "users",
        *[F.coalesce(F.col(f"hot_{k}"), empty).alias(f"hot_{k}") for k in KINDS],
    )
    mine, other = ([F.col(f"hot_{k}").alias(f"{s}_{k}") for k in KINDS] for s in ("a", "b"))
    return (
        _grid(quiet, mine, other)
        .filter(F.col("a") < F.col("b"))
        .groupBy("a", "b")
        .agg(
            F.bit_or(_kind_bit()).alias("kinds"),
            *[F.max(F.arrays_overlap(f"a_{k}", f"b_{k}")).alias(f"both_{k}") for k in KINDS],
        )
        .withColumns(_bits("kinds"))
        .drop("kinds")
    )


def _hot_partner_counts(hot: DataFrame, kind: str) -> DataFrame:
    """Other accounts sharing at least one hot entity, counted per distinct hot set."""
    sets = (
        hot.filter(F.size(f"hot_{kind}") > 0)
        .groupBy(F.col(f"hot_{kind}").alias("s"))
        .agg(F.count("*").alias("n"))
    )
    mine = sets.select("s", F.explode("s").alias("entity"))
    theirs = sets.select(F.col("s").alias("s2"), "n", F.explode("s").alias("entity"))
    per_set = (
        mine.join(theirs, "entity")
        .select("s", "s2", "n")
        .distinct()
        .groupBy("s")
        .agg((F.sum("n") - 1).alias(f"hotn_{kind}"))
    )
    return hot.join(per_set, F.col(f"hot_{kind}") == F.col("s")).select("account_id", f"hotn_{kind}")


def _hot_double(hot: DataFrame, one: str, two: str, name: str) -> DataFrame:
    """Accounts for which another account uses the same hot entity of both kinds."""
    combos = hot.select(
        "account_id", F.explode(f"hot_{one}").alias("e1"), f"hot_{two}"
    ).select("account_id", "e1", F.explode(f"hot_{two}").alias("e2"))
    crowded = combos.groupBy("e1", "e2").count().filter(F.col("count") > 1)
    return (
        combos.join(crowded, ["e1", "e2"], "left_semi")
        .select("account_id", F.lit(1).alias(name))
        .distinct()
    )


def sharing_features(sized: DataFrame, hot_accounts: int = HOT_ACCOUNTS) -> DataFrame:
    """Distinct sharers per kind, joint-sharing flags and the number of shared kinds.

    ``sized`` is a stored ``sized_links`` table. The hot half of the plan is built only if a
    hot entity exists.
    """
    any_hot = not sized.filter(F.col("users") > hot_accounts).isEmpty()
    hot = _hot_sets(sized, hot_accounts) if any_hot else None
    pairs = _quiet_pairs(sized, hot, hot_accounts)

    def shares(k: str) -> F.Column:
        return F.col(f"quiet_{k}") | F.col(f"both_{k}")

    ends = pairs.withColumn("a", F.explode(F.array("a", "b")))
    quiet = ends.groupBy("a").agg(
        *[F.count_if(F.col(f"quiet_{k}") & ~F.col(f"both_{k}")).alias(f"quietn_{k}") for k in KINDS],
        F.max((shares("device") & shares("address")).cast("int")).alias("quiet_da"),
        F.max((shares("instrument") & shares("phone")).cast("int")).alias("quiet_ip"),
    )
    out = sized.select("account_id").distinct().join(
        quiet.withColumnRenamed("a", "account_id"), "account_id", "left"
    )
    if any_hot:
        for k in KINDS:
            out = out.join(_hot_partner_counts(hot, k), "account_id", "left")
        out = out.join(_hot_double(hot, "device", "address", "hot_da"), "account_id", "left")
        out = out.join(_hot_double(hot, "instrument", "phone", "hot_ip"), "account_id", "left")
    else:
        none = F.lit(None).cast("bigint")
        out = out.withColumns({c: none for c in [*[f"hotn_{k}" for k in KINDS], "hot_da", "hot_ip"]})

    zero = F.lit(0).cast("bigint")
    count = {
        k: F.coalesce(F.col(f"quietn_{k}"), zero) + F.coalesce(F.col(f"hotn_{k}"), zero) for k in KINDS
    }
    kinds = sum(((count[k] > 0).cast("bigint") for k in KINDS), zero)
    nil = F.lit(0)
    return out.select(
        "account_id",
        *[count[k].alias(f"shared_{k}_count") for k in KINDS],
        F.greatest(F.coalesce("quiet_da", nil), F.coalesce("hot_da", nil)).cast("bigint").alias(
            "has_shared_device_and_address"
        ),
        F.greatest(F.coalesce("quiet_ip", nil), F.coalesce("hot_ip", nil)).cast("bigint").alias(
            "has_shared_payment_and_phone"
        ),
        kinds.alias("shared_entity_types_count"),
    )


def ip_events(orders: DataFrame, devices: DataFrame) -> DataFrame:
    """(ip_prefix, account, time) through the order's device."""
    prefixes = devices.select("device_id", "ip_prefix").distinct()
    return (
        orders.join(prefixes, "device_id")
        .filter(F.col("ip_prefix").isNotNull())
        .select("ip_prefix", "account_id", micros("order_timestamp").alias("t"))
    )


def ip_meetings(
    orders: DataFrame, devices: DataFrame, window_us: int = IP_WINDOW_US, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pairs of one IP prefix within the window, as ``met_once`` gives them."""
    return met_once(ip_events(orders, devices), ["ip_prefix"], "account_id", "t", window_us, known)


def ip_pairs(orders: DataFrame, devices: DataFrame, window_us: int = IP_WINDOW_US) -> DataFrame:
    once, again = ip_meetings(orders, devices, window_us)
    return once.unionByName(again.distinct())


def shared_ip_counts(pairs: DataFrame) -> DataFrame:
    """Partners per account from distinct pairs."""
    ends = pairs.select(F.explode(F.array("id_1", "id_2")).alias("account_id"))
    return ends.groupBy("account_id").agg(F.count("*").alias("shared_ip_prefix_count"))


def add_identity(
    features: DataFrame, orders: DataFrame, devices: DataFrame, hot_accounts: int = HOT_ACCOUNTS
) -> DataFrame:
    sized = stored_links(orders)
    out = (
        features.join(accounts_per_entity(sized), "account_id", "left")
        .join(sharing_features(sized, hot_accounts), "account_id", "left")
        .join(shared_ip_counts(ip_pairs(orders, devices)), "account_id", "left")
    )
    zero = F.lit(0).cast("bigint")
    whole = [f"shared_{k}_count" for k in KINDS] + [
        "has_shared_device_and_address", "has_shared_payment_and_phone",
        "shared_entity_types_count", "shared_ip_prefix_count",
    ]
    return out.withColumns(
        {
            **{c: F.coalesce(F.col(c), zero) for c in whole},
            **{f"accounts_per_{k}": F.coalesce(F.col(f"accounts_per_{k}"), F.lit(0.0)) for k in KINDS},
        }
    )
