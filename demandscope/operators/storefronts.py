"""Which storefronts a job works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandscope.config import STOREFRONTS


def chosen_storefronts(requests: DataFrame) -> DataFrame:
    """(request_id, place, storefront, lang, unknown) for comma-separated lists of storefronts (``request_id, stores``).

    Names count without case and surrounding spaces, repeated ones once. The order is that of the known storefronts, not of
    the request. Names that are not known are in ``unknown``. A request without a known one, an empty or a null
    one gets the first storefront.
    """
    known = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(key).alias("storefront"), F.lit(lang).alias("lang"))
                      for i, (key, lang) in enumerate(STOREFRONTS)))
    names = F.array_distinct(F.transform(F.split(F.lower(F.coalesce("stores", F.lit(""))), ","), lambda s: F.trim(s)))
    wanted = requests.select("request_id", names.alias("names"), known.alias("known"))
    picked = wanted.select("request_id", "known", F.filter("known", lambda k: F.array_contains("names", k["storefront"])).alias("picked"),
                           F.array_join(F.array_sort(F.filter("names", lambda n: (n != "") & ~F.exists(
                               "known", lambda k: k["storefront"] == n))), ",").alias("unknown"))
    return picked.select("request_id", "unknown", F.posexplode(F.when(F.size("picked") > 0, F.col("picked")).otherwise(
        F.slice("known", 1, 1))).alias("place", "s")).select("request_id", "place", "s.storefront", "s.lang", "unknown")
