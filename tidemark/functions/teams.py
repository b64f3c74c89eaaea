"""Team names of the league."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nicknames with their abbreviations, and aliases.
TEAMS: dict[str, tuple[str, ...]] = {
    "Cardinals": ("ARI",), "Falcons": ("ATL",), "Ravens": ("BAL",), "Bills": ("BUF",), "Panthers": ("CAR",), "Bears": ("CHI",), "Bengals": ("CIN",), "Browns": ("CLE",),
    "Cowboys": ("DAL",), "Broncos": ("DEN",), "Lions": ("DET",), "Packers": ("GB",), "Texans": ("HOU",), "Colts": ("IND",), "Jaguars": ("JAX", "JAC"), "Chiefs": ("KC",),
    "Chargers": ("LAC",), "Rams": ("LAR", "LA"), "Raiders": ("LV", "OAK"), "Dolphins": ("MIA",), "Vikings": ("MIN",), "Patriots": ("NE",), "Saints": ("NO",), "Giants": ("NYG",),
    "Jets": ("NYJ",), "Eagles": ("PHI",), "Steelers": ("PIT",), "Seahawks": ("SEA",), "49ers": ("SF",), "Buccaneers": ("TB",), "Titans": ("TEN",), "Commanders": ("WAS", "WSH"),
}
ALIASES = {"Bucs": "Buccaneers", "Niners": "49ers"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def canonical_team(name: Column) -> Column:
    """The nickname for a nickname or an alias, else NULL."""
    return F.try_element_at(_map({t: t for t in TEAMS} | ALIASES), name)


def team_of_abbreviation(code: Column) -> Column:
    return F.try_element_at(_map({a: t for t, codes in TEAMS.items() for a in codes}), code)


def abbreviations(team: Column) -> Column:
    table = F.create_map(*[x for t, codes in TEAMS.items() for x in (F.lit(t), F.array(*map(F.lit, codes)))])
    return F.try_element_at(table, team)


def game_teams(description: Column) -> Column:
    """[away, home] if the text is "Some Team @ Other Team" with two known nicknames, else NULL."""
    sides = F.filter(F.split(description, "@"), lambda s: F.trim(s) != "")
    names = F.transform(sides, lambda s: canonical_nickname(F.element_at(F.split(F.trim(s), r"\s+"), -1)))
    return F.when((F.size(names) == 2) & ~F.exists(names, lambda n: n.isNull()), names)


def canonical_nickname(word: Column) -> Column:
    return F.try_element_at(_map({t: t for t in TEAMS}), word)


def starts_with_team(name: Column, team: Column) -> Column:
    """Whether the text's first word is one of the team's abbreviations, or the nickname is part of the text."""
    first = F.element_at(F.split(F.trim(name), r"\s+"), 1)
    return F.coalesce(F.array_contains(abbreviations(team), first), F.lit(False)) | F.coalesce(F.contains(name, team), F.lit(False))
