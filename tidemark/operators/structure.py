"""Market structure: concentration, verdicts, maturity, seller scores, company classes and buyer reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import text as X

# Weights of seller signals and cuts of verdicts.
POINTS = {"years_15": 12, "years_10": 7, "years_7": 3, "new": -10, "single": 4, "small": 2, "sole": 14, "no_successor": 8, "charge": 12, "resigned": 8, "renamed": 3, "group": -25, "young": -8, "new_charge": -6}
DEEP_TARGETS, TOP5_CONCENTRATED, TOP5_MODERATE = 300, 40.0, 20.0
INFANT_ENTRY, MATURE_ENTRY = 15.0, 8.0


def concentration(rows: DataFrame, *, indie_sites: int = 3) -> DataFrame:
    """rows (niche, unit): one row a location. Locations, providers, single sites, independents (by their sites in all niches), HHI, top five."""
    sizes = rows.groupBy("niche", "unit").agg(F.count(F.lit(1)).alias("n"))
    every = sizes.groupBy("unit").agg(F.sum("n").alias("everywhere"))
    ranked = sizes.join(every, "unit").withColumn("place", F.row_number().over(Window.partitionBy("niche").orderBy(F.desc("n"), "unit")))
    # sum((n / N)^2) = sum(n^2) / N^2, so one pass gives all.
    sums = ranked.groupBy("niche").agg(
        F.sum("n").alias("locations"), F.count(F.lit(1)).alias("providers"), F.round(100.0 * F.count_if(F.col("n") == 1) / F.count(F.lit(1)), 6).alias("single_site_pct"),
        F.count_if(F.col("everywhere") <= indie_sites).alias("indie"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.when(F.col("place") <= 5, F.col("n"))).alias("top"),
    )
    return sums.select("niche", "locations", "providers", "single_site_pct", "indie", F.round(F.col("squares") / F.col("locations") / F.col("locations"), 6).alias("hhi"), F.round(100.0 * F.col("top") / F.col("locations"), 6).alias("top5"))


def verdict(indie: Column, hhi: Column, top5: Column) -> Column:
    """Density first, concentration second."""
    return (
        F.when(indie.isNull() | (indie < C.MIN_TARGETS), "Too small to roll up")
        .when((hhi >= C.HHI_CONCENTRATED) | (top5 >= TOP5_CONCENTRATED), "Already consolidated")
        .when((hhi >= C.HHI_MODERATE) | (top5 >= TOP5_MODERATE), "Consolidating")
        .when(indie < C.THIN_TARGETS, "Thin - regional platform at best")
        .otherwise("Fragmented - roll-up runway")
    )


def mature_verdict(indie: Column, hhi: Column, top5: Column, maturity_: Column) -> Column:
    """The verdict on economic owners, in which a fragmented niche's maturity decides."""
    plain = verdict(indie, hhi, top5)
    kinds = F.when(maturity_ == "INFANT", "Fragmented but INFANT - a gold rush, not a roll-up").when(maturity_ == "MATURE", "Fragmented and MATURE - real roll-up runway").otherwise("Fragmented, still settling - too early to call")
    return F.when(plain == "Fragmented - roll-up runway", kinds).otherwise(plain)


def headroom_score(indie: Column, hhi: Column, top5: Column, maturity_: Column | None = None) -> Column:
    """60 % density, 40 % headroom, unrounded; half of it for an infant market. bround() gives the printed value."""
    density = 100.0 * F.least(F.lit(1.0), indie / float(DEEP_TARGETS))
    part = lambda x, cut: 1 - F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)) / cut)
    raw = 0.6 * density + 0.4 * 100.0 * F.least(part(hhi, C.HHI_CONCENTRATED), part(top5, TOP5_CONCENTRATED))
    factor = F.lit(1.0) if maturity_ is None else F.when(maturity_ == "INFANT", 0.5).when(maturity_ == "SETTLING", 0.8).otherwise(1.0)
    return F.when(indie.isNull() | (indie < C.MIN_TARGETS), 0.0).otherwise(raw * factor)


def maturity(entry_rate: Column) -> Column:
    return F.when(entry_rate >= INFANT_ENTRY, "INFANT").when(entry_rate <= MATURE_ENTRY, "MATURE").when(entry_rate.isNotNull(), "SETTLING")


def structural_score(sites: Column, years: Column) -> Column:
    """The part of the seller score that needs no registry."""
    p = POINTS
    tenure = F.when(years >= 15, p["years_15"]).when(years >= 10, p["years_10"]).when(years >= 7, p["years_7"]).when(years < 3, p["new"]).otherwise(0)
    return tenure + F.when(sites == 1, p["single"]).when(sites.between(2, 3), p["small"]).otherwise(0)


def seller_score(sites: str, years: str, signs: dict[str, str]) -> Column:
    """0 to 100: the structural part and the points of each sign that a row shows."""
    extra = sum((F.when(F.col(c), POINTS[sign]).otherwise(0) for sign, c in signs.items()), F.lit(0))
    return F.least(F.greatest(structural_score(F.col(sites), F.col(years)) + extra, F.lit(0)), F.lit(100)).cast("int")


def buyer_score(quadrant_: str, demand_: str, indie: str, top5: str, hhi: str, entry: str) -> Column:
    """0 to 100 within the buy list: 40 % targets, 35 % headroom, 25 % how cold entry is; build ideas count by demand alone."""
    share = lambda c, cut, none: F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(none)) / cut)
    density = share(indie, float(DEEP_TARGETS), 0.0)
    headroom = F.least(1 - share(top5, TOP5_CONCENTRATED, 0.0), 1 - share(hhi, C.HHI_CONCENTRATED, 0.0))
    raw = 100.0 * (0.40 * density + 0.35 * headroom + 0.25 * (1 - share(entry, C.ENTRY_HOT, C.ENTRY_WARM)))
    factor = F.when(F.col(demand_) == "falling", 0.5).when(F.col(demand_) == "booming", 0.9).otherwise(1.0)
    build = F.when(F.col(demand_) == "booming", 60).when(F.col(demand_) == "growing", 40).otherwise(0)
    buy = F.col(quadrant_).isin("buy_window", "declining") & F.col(indie).isNotNull()
    return F.when(F.col(quadrant_) == "build_only", build).when(buy, F.bround(raw * factor).cast("int")).otherwise(0)


def niche_market(rows: DataFrame) -> DataFrame:
    """rows (niche, unit, region, sector, is_new): one row a location. Distinct values are made one by one, not by copies of all rows."""
    keys = rows.groupBy("niche", "unit", "region", "sector").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("new"))
    sums = keys.groupBy("niche").agg(F.sum("n").alias("locations"), F.sum("new").alias("new_12m"))
    for name, c in (("providers", "unit"), ("regions", "region"), ("sectors", "sector")):
        sums = sums.join(keys.select("niche", c).distinct().groupBy("niche").agg(F.count(F.col(c)).alias(name)), "niche")
    return sums.select("niche", "locations", "providers", "regions", "sectors", "new_12m")


def officer_facts(officers: DataFrame, companies: DataFrame, days: int = 7) -> DataFrame:
    """officers (company, officer, appointed, resigned), companies (company, created): active officers, whether one is alone, and who came with the company."""
    came = F.abs(F.datediff("appointed", "created")) <= days
    active = F.count_if(~F.col("resigned"))
    return officers.join(companies, "company").groupBy("company").agg(active.alias("active"), (active == 1).alias("sole"), F.count_if(came).alias("founders"))


FORENAMES = ["sarah", "john", "jane", "emma", "james", "david", "anna", "omar", "tim"]
TRADE = ["physio", "physiotherapy", "clinic", "dental", "studio", "skin", "group", "care", "health", "therapy"]
BUSINESS = "unit units suite suites floor floors office offices business park centre center industrial estate chambers house mill works studio studios mall arcade parade precinct retail plaza court wharf yard clinic hospital surgery".split()


def classify_companies(rows: DataFrame, forenames: list[str] = FORENAMES, trade: list[str] = TRADE) -> DataFrame:
    """rows (name, director, n_directors, psc, address, sics) with strength, support and label; the name signal is mandatory for a personal service."""
    array = lambda xs: F.array(*map(F.lit, xs))
    words = F.filter(X.tokens(F.col("name")), lambda w: ~w.isin("ltd", "limited", "llp"))
    hit = F.filter(F.transform(words, lambda w, i: F.when(w.isin(trade), i)), lambda i: i.isNotNull())
    lead = F.slice(words, 1, F.when(F.size(hit) > 0, F.get(hit, F.lit(0))).otherwise(F.size(words)))
    initials = F.size(F.filter("lead", lambda w: F.length(w) == 1))
    first, second = F.get("lead", F.lit(0)), F.get("lead", F.lit(1))
    strength = (
        F.when(F.lower("name").rlike(r"^\s*(dr|mr|mrs|ms|miss|prof)\b"), "strong")
        .when((F.size("lead") == 0) | (F.size("lead") > 4), F.lit(None))
        .when((initials > 0) & (F.size("lead") - initials == 1), "strong")
        .when(F.col("name").rlike(r"\w'[sS]\b"), "weak")
        .when((F.size("lead") == 2) & first.isin(forenames) & ~second.isin(forenames), "weak")
        .when((F.size("lead") == 1) & first.isin(forenames), "weak")
    )
    surname = F.regexp_replace(F.lower(F.split_part("director", F.lit(","), F.lit(1))), "[^a-z]", "")
    named = F.coalesce((F.length(surname) >= 3) & F.array_contains(words, surname), F.lit(False))
    business = F.arrays_overlap(X.tokens(F.col("address")), array(BUSINESS))
    checked = F.col("n_directors").isNotNull()
    signs = [named, F.coalesce(F.col("n_directors") == 1, F.lit(False)), F.coalesce((F.col("psc") == 1) & (F.col("n_directors") == 1), F.lit(False)), F.col("sics") == array(["86900"]), ~business]
    support = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
    label = F.when((F.col("strength") == "strong"), "personal_service").when((F.col("strength") == "weak") & (F.col("support") >= 2), "personal_service").when(F.col("strength") == "weak", "unknown").otherwise("real")
    confidence = F.when(F.col("label") == "unknown", "name looks personal but nothing corroborates it").when(~checked, "low").when((F.col("label") == "real") & business, "high").when(named, "high").otherwise("medium")
    out = rows.withColumn("lead", lead).withColumn("strength", strength).withColumn("support", support).withColumn("label", label)
    return out.select("name", "strength", "support", "label", confidence.alias("confidence"))


def demand(t0: Column, t1: Column) -> Column:
    """The demand read of search and waits."""
    lit_ = (t1 >= C.RISING) | (t0 >= C.RISING)
    return F.when(t0.isNull() & t1.isNull(), "unknown").when(t1 <= C.FALLING, "falling").when(t1 >= C.BOOM, "booming").when(F.coalesce(lit_, F.lit(False)), "growing").otherwise("flat")


def supply(indie: Column, top5: Column, hhi: Column, entry: Column) -> Column:
    """The supply read for acquisitions."""
    return (
        F.when(indie.isNull(), "unknown")
        .when(indie < C.MIN_TARGETS, "none")
        .when((top5 >= TOP5_CONCENTRATED) | (hhi >= C.HHI_CONCENTRATED), "consolidated")
        .when(entry >= C.ENTRY_HOT, "filling")
        .otherwise("fragmented")
    )


def quadrant(demand_: Column, supply_: Column) -> Column:
    """What the two reads mean for a buyer; consolidation beats everything."""
    return (
        F.when(supply_.isin("unknown", "unobservable"), "no_data")
        .when(supply_ == "consolidated", "too_late")
        .when(supply_ == "none", F.when(demand_.isin("growing", "booming"), "build_only").otherwise("nothing_here"))
        .when(supply_ == "filling", "wait_or_build")
        .when(demand_ == "falling", "declining")
        .otherwise("buy_window")
    )
