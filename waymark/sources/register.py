"""The register's replicated tables, and one run over them."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame

from waymark.operators import sync

# Each table's name on the remote side, and its fields as (local name, tag, remote name).
REMOTE = {
    "arg_adrese": "AK.ARG_ADRESE",
    "arg_adrese_arh": "AK.ARG_ADRESE_ARH",
    "art_vieta": "AK.ART_VIETA",
    "art_nlieta": "AK.ART_NLIETA",
    "art_eka_geo": "AK.ART_EKA_GEO",
    "art_dziv": "AK.ART_DZIV",
}
TABLES = {
    "arg_adrese": [
        ("adr_cd", "pk", "adr_cd"),
        ("tips_cd", "fk", "tips_cd"),
        ("statuss", "string", "statuss"),
        ("apstipr", "string", "apstipr"),
        ("apst_pak", "int", "apst_pak"),
        ("std", "string", "std"),
        ("vkur_cd", "fk", "vkur_cd"),
        ("t1", "string", "t1"),
        ("t2", "string", "t2"),
        ("t3", "string", "t3"),
        ("t4", "string", "t4"),
        ("t5", "string", "t5"),
        ("t6", "string", "t6"),
        ("dat_sak", "datetime", "dat_sak"),
        ("dat_beig", "datetime", "dat_beig"),
        ("dat_mod", "datetag", "dat_mod"),
    ],
    "arg_adrese_arh": [
        ("id", "pk", "id"),
        ("adr_cd", "fk", "adr_cd"),
        ("tips_cd", "fk", "tips_cd"),
        ("statuss", "string", "statuss"),
        ("apstipr", "string", "apstipr"),
        ("apst_pak", "int", "apst_pak"),
        ("std", "string", "std"),
        ("vkur_cd", "fk", "vkur_cd"),
        ("t1", "string", "t1"),
        ("t2", "string", "t2"),
        ("t3", "string", "t3"),
        ("t4", "string", "t4"),
        ("t5", "string", "t5"),
        ("t6", "string", "t6"),
        ("dat_sak", "datetime", "dat_sak"),
        ("dat_beig", "datetime", "dat_beig"),
        ("dat_mod", "datetag", "dat_mod"),
    ],
    "art_vieta": [
        ("kods", "pk", "kods"),
        ("tips_cd", "fk", "tips_cd"),
        ("apstipr", "string", "apstipr"),
        ("apst_pak", "int", "apst_pak"),
        ("statuss", "string", "statuss"),
        ("vkur_cd", "fk", "vkur_cd"),
        ("vkur_tips", "int", "vkur_tips"),
        ("nosaukums", "string", "nosaukums"),
        ("sort_nos", "string", "sort_nos"),
        ("atrib", "string", "atrib"),
        ("dat_sak", "datetime", "dat_sak"),
        ("dat_beig", "datetime", "dat_beig"),
        ("dat_mod", "datetag", "dat_mod"),
    ],
    "art_nlieta": [
        ("kods", "pk", "kods"),
        ("tips_cd", "fk", "tips_cd"),
        ("statuss", "string", "statuss"),
        ("apstipr", "string", "apstipr"),
        ("apst_pak", "int", "apst_pak"),
        ("vkur_cd", "fk", "vkur_cd"),
        ("vkur_tips", "int", "vkur_tips"),
        ("nosaukums", "string", "nosaukums"),
        ("sort_nos", "string", "sort_nos"),
        ("atrib", "string", "atrib"),
        ("pnod_cd", "fk", "pnod_cd"),
        ("for_build", "string", "for_build"),
        ("dat_sak", "datetime", "dat_sak"),
        ("dat_beig", "datetime", "dat_beig"),
        ("dat_mod", "datetag", "dat_mod"),
    ],
    "art_eka_geo": [
        ("mslink", "pk", "mslink"),
        ("vieta_cd", "fk", "vieta_cd"),
        ("koord_x", "decimal", "koord_x"),
        ("koord_y", "decimal", "koord_y"),
    ],
    "art_dziv": [
        ("kods", "pk", "kods"),
        ("tips_cd", "fk", "tips_cd"),
        ("statuss", "string", "statuss"),
        ("apstipr", "string", "apstipr"),
        ("apst_pak", "int", "apst_pak"),
        ("vkur_cd", "fk", "vkur_cd"),
        ("vkur_tips", "int", "vkur_tips"),
        ("nosaukums", "string", "nosaukums"),
        ("sort_nos", "string", "sort_nos"),
        ("atrib", "string", "atrib"),
        ("dat_sak", "datetime", "dat_sak"),
        ("dat_beig", "datetime", "dat_beig"),
        ("dat_mod", "datetag", "dat_mod"),
    ],
}


def fields(table: str) -> list[tuple[str, str, str]]:
    """(local name, tag, remote name) of a table's fields."""
    return TABLES[table]


def key(table: str) -> str:
    return next(name for name, tag, _ in fields(table) if tag == "pk")


def mark(table: str) -> str | None:
    return next((name for name, tag, _ in fields(table) if tag == "datetag"), None)


def replicate(tables: list[str], read_source: Callable[[str], DataFrame], read_target: Callable[[str], DataFrame], write: Callable[[str, DataFrame], None], verify: bool = False) -> list[str]:
    """Brings each table's target up to date; returns the tables in the order done. ``read_source`` gets the remote name."""
    for t in tables:
        source = sync.renamed(read_source(REMOTE[t]), fields(t))
        write(t, sync.migrate(read_target(t), source, key(t), mark(t), verify))
    return tables


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    """Command line of a replication: connections of both sides, tables (all without any), --verify; --lock names a file for the caller's own lock."""
    p = argparse.ArgumentParser(prog="waymark-sync")
    for side in ("target", "source"):
        for what in ("url", "driver", "user", "password"):
            p.add_argument(f"--{side}-{what}")
    p.add_argument("--lock")
    p.add_argument("--verify", action="store_true")
    p.add_argument("tables", nargs="*", metavar="table")
    out = p.parse_args(args)
    if unknown := set(out.tables) - set(TABLES):
        p.error(f"unknown tables {sorted(unknown)}")
    out.tables = out.tables or list(TABLES)
    return out
