"""What calls cost: by endpoint for those who pay as they go, by the month for subscribers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prices in cents of a call by its class, the classes of endpoints that aren't simple, and monthly prices.
CLASSES = {"simple": 5, "complex": 10, "advanced": 15}
ENDPOINTS = {"/v1/companies/{ticker}/changes": "complex", "/v1/entities/traverse": "advanced", "/v1/documents/search": "advanced", "/v1/batch": "advanced"}
MONTHLY = {"pro": 19_900, "business": 49_900}


def call_cost(path: Column, tier: Column) -> Column:
    """Cents of a call: nothing for subscribers; paths of companies' changes are one endpoint; what is unknown is simple."""
    endpoint = F.when(path.contains("/companies/") & path.contains("/changes"), "/v1/companies/{ticker}/changes").otherwise(path)
    table = F.create_map(*[F.lit(x) for e, c in ENDPOINTS.items() for x in (e, CLASSES[c])])
    return F.when(tier.isin(*MONTHLY), 0).otherwise(F.coalesce(F.try_element_at(table, endpoint), F.lit(CLASSES["simple"])))


def monthly_cost(tier: Column, calls: Column, mix: Column) -> Column:
    """Cents of a month: the subscription, or calls by the price of their mix, the mean of all prices for a balanced one."""
    price = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), mix).cast("double"), F.lit(sum(CLASSES.values()) / len(CLASSES)))
    flat = F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTHLY.items() for x in kv]), tier)
    return F.coalesce(flat, F.round(calls * price).cast("int"))
