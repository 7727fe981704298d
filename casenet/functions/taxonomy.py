"""Closed domains and the maps between them, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domains of the data model.
ENTITY_TYPES = ("PERSON", "PHONE", "EMAIL", "VEHICLE", "LOCATION", "ORGANIZATION", "BANK_ACCOUNT", "TRANSACTION", "SOCIAL_MEDIA_ACCOUNT", "CRIMINAL_CASE", "POLICE_STATION", "STATUTE", "OTHER")
BUSINESS_IDENTIFIERS = ("PHONE", "EMAIL", "BANK_ACCOUNT", "VEHICLE_REGISTRATION")
GRAPH_TYPES = {"PERSON": "Person", "LOCATION": "Location", "POLICE_STATION": "Location", "STATUTE": "CaseRef", "ORGANIZATION": "Organization", "PHONE": "Phone", "EMAIL": "Email", "TRANSACTION": "Transaction", "BANK_ACCOUNT": "Account"}
RELATION_TYPES = {"owns": "OWNS", "uses": "COMMUNICATED_WITH", "visited": "LOCATED_AT", "transaction": "TRANSFERRED_TO", "connected_to": "ASSOCIATED_WITH", "associated_with": "ASSOCIATED_WITH"}
EXTERNAL_TYPES = {"LOCATION": "POLICE_STATION", "CRIME TYPE": "STATUTE", "PERSON": "PERSON"}
TIERS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def mapped(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    found = F.create_map(*map(F.lit, chain.from_iterable(table.items())))[value]
    return found if default is None else F.coalesce(found, F.lit(default))


def graph_type(entity_type: Column) -> Column:
    return mapped(entity_type, GRAPH_TYPES, "CaseRef")


def relation_type(name: Column) -> Column:
    return mapped(F.lower(name), RELATION_TYPES, "ASSOCIATED_WITH")


def external_type(name: Column) -> Column:
    """Null for types that are not taken over."""
    return mapped(name, EXTERNAL_TYPES)


def risk_level(tier: Column) -> Column:
    clean = F.trim(F.upper(tier))
    return F.when(clean.isin(*TIERS), clean).otherwise("LOW")


def tier_rank(tier: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), tier), F.lit(0))
