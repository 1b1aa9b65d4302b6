"""Rename plans: free names as a table, carrying them out in two phases, and undoing a run.

Names affect each other only if they are equal up to numbers at their end ("A", "A (2)", "A (2) (2)"), so
numbering is a fold over each such family; carrying a plan out is a step of the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.functions.text import safe_file_name

_UNSAFE = re.compile(r'[<>:"/\\|?*]')
#: Numbers at the end of a name, of which any may have been given by an earlier run.
_NUMBERS = r"( \(\d+\))+$"


@dataclass
class Outcome:
    renamed: list[tuple[str, str]] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)
    cancelled: bool = False


def safe_name(title: str) -> str:
    return _UNSAFE.sub("", title).strip() + ".pdf"


def _fold(plans: Iterable[tuple[str, str | None]], taken: set[str]) -> Iterator[str | None]:
    """The new name of each (old name, wanted name), in order; ``taken`` are names in lower case. One already right keeps its name."""
    plans = list(plans)
    taken = taken | {old.lower() for old, wanted in plans if wanted == old}
    tried: dict[str, int] = {}
    for old, wanted in plans:
        if not wanted or wanted == old:
            yield wanted
            continue
        name, k = wanted, tried.get(wanted.lower(), 1)
        while name.lower() in taken or k > 1 and name == wanted:
            k += 1
            name = f"{wanted[:-4]} ({k}).pdf"
        tried[wanted.lower()] = k
        taken.add(name.lower())
        yield name


def free_names(plans: Iterable[tuple[str, str | None]], existing: Iterable[str]) -> list[tuple[str, str | None]]:
    """(old name, title) in plan order -> (old name, new name): the title's name, or the next number that is free.

    Files that have their name already keep it, whatever the order. A name is also taken by earlier plans, and by files that no plan moves."""
    plans = [(old, safe_name(title) if title else None) for old, title in plans]
    moving = {old.lower() for old, wanted in plans if wanted}
    return list(zip((old for old, _ in plans), _fold(plans, {n.lower() for n in existing if n.lower() not in moving})))


def claimed(plans: DataFrame, existing: DataFrame) -> DataFrame:
    """``pos, old, new, outcome`` of files that are no documents (pos, old, ext, title; null title: none was found).

    The first file by ``pos`` claims a title, whatever comes of it. It is ``renamed``, ``kept`` if its name is right, or
    refused as ``taken``: no file is written over and no number is given. ``existing`` (file_name) are the directory's
    names in any case; a name counts as taken even if its file is about to move. Others are ``claimed`` or ``unmatched``.
    """
    rows = plans.select("pos", "old", "title", safe_file_name("title", F.col("ext")).alias("wanted"))
    first = rows.where("title IS NOT NULL").groupBy("title").agg(F.min("pos").alias("pos")).withColumn("_won", F.lit(True))
    won = rows.join(first, ["title", "pos"], "left").withColumn("_key", F.when(F.col("_won") & (F.col("wanted") != F.col("old")), F.lower("wanted")))
    names = won.where("_key IS NOT NULL").groupBy("_key").agg(F.min("pos").alias("_first"))
    free = names.join(existing.select(F.lower("file_name").alias("_key")), "_key", "left_anti")
    outcome = (
        F.when(F.col("title").isNull(), "unmatched").when(F.col("_won").isNull(), "claimed").when(F.col("_key").isNull(), "kept")
        .when(F.col("_first") == F.col("pos"), "renamed").otherwise("taken")
    )
    told = won.join(free, "_key", "left").withColumn("outcome", outcome)
    return told.select("pos", "old", F.when(F.col("outcome") == "renamed", F.col("wanted")).alias("new"), "outcome")


def numbered(plans: DataFrame) -> DataFrame:
    """``pos, old, new`` of plans (pos, old, title; null title: the file stays, and takes its name), as ``free_names`` gives them.

    A row a file: a family of names, without texts, is folded in one task.
    """
    wanted = F.when(F.coalesce("title", F.lit("")) != "", safe_file_name("title"))
    rows = plans.select("pos", "old", wanted.alias("wanted"))
    stem = F.regexp_replace(F.lower(F.coalesce("wanted", "old")), r"\.pdf$", "")

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        old, want = group["old"].to_pylist(), group["wanted"].to_pylist()
        new = _fold(zip(old, want), {o.lower() for o, w in zip(old, want) if not w})
        return pa.table({"pos": group["pos"], "old": group["old"], "new": pa.array(new, pa.string())})

    family = rows.withColumn("family", F.regexp_replace(stem, _NUMBERS, ""))
    return family.groupBy("family").applyInArrow(fold, "pos long, old string, new string")


def apply_plan(directory: str, pairs: Iterable[tuple[str, str | None]], output: str | None = None) -> Outcome:
    """Rename in two phases, through names that nothing else has; a failed move is put back.

    A file that has its name already stays where it is, also if the output folder is another one, which is made if
    it is missing. An interrupt puts back what was under way, keeps what was done, and is told as ``cancelled``.
    """
    output, done, parked = output or directory, Outcome(), {}
    os.makedirs(output, exist_ok=True)
    try:
        for i, (old, new) in enumerate(pairs):
            if new is None or new == old:
                done.kept.append(old)
                continue
            between = os.path.join(directory, f".catalink-{os.getpid()}-{i}.tmp")
            parked[between] = (old, new)  # before the move, so that an interrupt right after it finds the file
            try:
                os.rename(os.path.join(directory, old), between)
            except OSError:
                del parked[between]
                done.failed.append(old)
        for between, (old, new) in list(parked.items()):
            target = os.path.join(output, new)
            try:
                if os.path.exists(target):
                    raise FileExistsError(target)
                os.rename(between, target)
                done.renamed.append((old, new))
            except OSError:
                os.rename(between, os.path.join(directory, old))
                done.failed.append(old)
            del parked[between]
    except KeyboardInterrupt:
        done.cancelled = True
        for between, (old, new) in parked.items():
            if os.path.exists(between):
                os.rename(between, os.path.join(directory, old))
            elif (old, new) not in done.renamed and not os.path.exists(os.path.join(directory, old)) and os.path.exists(os.path.join(output, new)):
                done.renamed.append((old, new))  # moved just before the interrupt
    return done


def undo_plan(renames: Iterable[tuple[str, str]], existing: Iterable[str]) -> tuple[list[tuple[str, str]], int]:
    """(new name, old name) of the renames whose new name is still there, last first, and how many are not."""
    there, renames = set(existing), [(old, new) for old, new in renames if old != new]
    back = [(new, old) for old, new in reversed(renames) if new in there]
    return back, len(renames) - len(back)


def undone(renames: DataFrame, existing: DataFrame) -> DataFrame:
    """``pos, old, new`` that take renames (pos, old, new) back, those whose new name ``existing`` (file_name) still has."""
    there = existing.select(F.col("file_name").alias("new")).distinct()
    back = renames.where(F.col("new").isNotNull() & (F.col("old") != F.col("new"))).join(there, "new", "left_semi")
    return back.select("pos", F.col("new").alias("old"), F.col("old").alias("new"))


def undo_last_run(directory: str, renames: Iterable[tuple[str, str]]) -> tuple[Outcome, int]:
    """Take a run's renames back in its folder: (what happened, how many names were gone). The caller drops the index entries of
    ``renamed`` and, unless it was ``cancelled``, the manifest."""
    back, gone = undo_plan(renames, os.listdir(directory))
    there = {n.lower() for n in os.listdir(directory)} - {new.lower() for new, _ in back}
    wanted = [(new, old if old.lower().endswith(".pdf") else f"{old}.pdf") for new, old in back]
    return apply_plan(directory, zip((new for new, _ in wanted), _fold(wanted, there))), gone
