"""What a machine may run and with how many tasks, and whether a submission is sound: column expressions with parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of compiler wrappers, free bytes below which the memory file system is not used, shares of the processors.
WRAPPERS = ("ccache", "distcc", "icecc")
LEAST_SHM = 10 << 30
DEDICATED_PERCENT, USER_PERCENT, POOR_PROCESSORS = 95, 40, 16


def is_wrapper(path: Column) -> Column:
    """Whether an executable, or what it links to, only passes calls on."""
    return path.rlike(f"({'|'.join(WRAPPERS)})$")


def executable(mode: Column, owner: Column, group: Column, uid: Column, groups: Column) -> Column:
    """Whether a user with some groups may run a file with this mode: by the owner's, the group's or the others' bit."""
    bit = lambda n: mode.bitwiseAND(F.lit(n)) != 0
    return bit(0o100) & (owner == uid) | bit(0o010) & F.array_contains(groups, group) | bit(0o001)


def submit_error(pid: Column, path: Column, args: Column, cache_control: Column, digest: Column) -> Column:
    """Why a submission is refused, null if it is not: the first of its faults. Nulls count as missing."""
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    return (
        F.when(F.coalesce(pid, F.lit(0)) <= 1, "bad pid").when(empty(path), "no source path").when(empty(args), "no arguments")
        .when(~F.coalesce(cache_control.between(0, 2), F.lit(False)), "bad cache control").when((cache_control != 0) & empty(digest), "no digest")
    )


def in_cgroup(lines: Column) -> Column:
    """Whether one of the lines ``id:controllers:path`` puts the process into a group of its own: the unified hierarchy, or cpu or
    memory limited outside the root and the users' slice."""

    def own(line: Column) -> Column:
        part = F.split(line, ":", 3)
        limits = F.arrays_overlap(F.split(F.try_element_at(part, F.lit(2)), ","), F.array(F.lit("cpu"), F.lit("memory")))
        return line.startswith("0::") | F.coalesce(limits & ~F.try_element_at(part, F.lit(3)).isin("/", "/user.slice"), F.lit(False))

    return F.exists(lines, own)


def executor_limit(flag: Column, dedicated: Column, processors: Column, grouped: Column) -> Column:
    """Tasks of others that a machine takes: the flag if it is not negative, else a share of the processors; a user's machine
    takes none in a group of its own or with few processors."""
    share = lambda percent: F.floor(processors * percent / 100)
    return F.when(flag >= 0, flag).when(dedicated, share(DEDICATED_PERCENT)).when(grouped | (processors <= POOR_PROCESSORS), 0).otherwise(share(USER_PERCENT)).cast("long")


def local_limits(flag: Column, quota: Column, processors: Column, ratio: float = 1.0) -> Column:
    """struct(heavy, light): tasks of its own that a machine runs, from the flag or half of what it may use, and light ones beside."""
    heavy = F.when(flag > 0, flag).otherwise(F.greatest(F.floor(F.least(processors, F.coalesce(quota, processors)) / 2), F.lit(1))).cast("long")
    return F.struct(heavy.alias("heavy"), (heavy + F.floor(heavy * ratio)).cast("long").alias("light"))


def temp_dir(flag: Column, free: Column) -> Column:
    """Where temporary files go: nowhere with an empty flag, on disk while the memory file system has little room, else there."""
    return F.when(flag == "", "").when(free < LEAST_SHM, "/tmp").otherwise("/dev/shm")


def is_alive(state: Column) -> Column:
    """Whether the letter that the system shows for a process is of one that has not ended; null if there is none."""
    return ~state.isin("Z", "x", "X")


def quota_processors(quota: Column, period: Column, processors: Column) -> Column:
    """Processors that a group of processes may use, null if it has no limit: neither number may be missing or below one."""
    return F.when((quota > 0) & (period > 0), F.least(processors, F.floor(quota / period))).cast("long")


#: Fields of a memory report and the names of its lines.
MEMORY = {
    "mem_total": "MemTotal", "mem_free": "MemFree", "mem_available": "MemAvailable", "buffers": "Buffers", "cached": "Cached",
    "swap_total": "SwapTotal", "swap_free": "SwapFree",
}


def memory_report(text: Column) -> Column:
    """struct of the fields of ``MEMORY`` in KiB, from lines ``name: number [unit]``; lines of another form do not count, the last
    of a name does, and what is missing is 0. Null for a null text."""

    def field(name: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?m)^{name}:[ \t]+(-?[0-9]{{1,18}})"), F.lit(1))
        return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("long"), F.lit(0))

    return F.when(text.isNotNull(), F.struct(*[field(name).alias(c) for c, name in MEMORY.items()]))


def idle_seconds(text: Column, per_second: int = 100) -> Column:
    """Seconds that the processors have been idle, the fourth number of the first line; null if it is not positive."""
    ticks = F.regexp_extract(text, r"\A[a-z]+(?:[ \t]+[0-9]+){3}[ \t]+([0-9]{1,18})", 1).try_cast("long")
    return F.when(ticks > 0, ticks.cast("double") / per_second)


def load_last_minute(text: Column) -> Column:
    """The first load average, rounded up; null if there is none."""
    return F.ceil(F.regexp_extract(text, r"\A([0-9]{1,9}(?:\.[0-9]{1,9})?)(?:\s|\z)", 1).try_cast("decimal(20,9)")).cast("long")
