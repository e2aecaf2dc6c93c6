"""String transforms as column expressions: splitting, escaping, sizes, times and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTROL = (("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v"))
#: Longest path.
PATH_MAX = 4096


def split_parts(s: Column, delimiter: str) -> Column:
    """Parts between delimiters, without empty ones."""
    return F.filter(F.split(s, "\\Q" + delimiter + "\\E"), lambda x: x != "")


def split_tokens(s: Column) -> Column:
    """Comma-separated tokens, empty ones included."""
    return F.split(s, ",", -1)


def base_name(s: Column) -> Column:
    return F.substring_index(s, "/", -1)


def directory_name(s: Column) -> Column:
    return F.regexp_replace(s, "/[^/]*$", "")


def shell_escape(s: Column) -> Column:
    """Backslash escapes for a shell word; single quotes stay as they are."""
    s = F.regexp_replace(s, r'([ ><!"#$&()*,:;?@\[\\\]`{}])', r"\\$1")
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), _CONTROL, s)


def command_line(words: Column, program: Column | None = None) -> Column:
    """Escaped words joined by spaces, after the program if given."""
    parts = F.transform(words, shell_escape)
    return F.array_join(parts if program is None else F.concat(F.array(program), parts), " ")


def parse_size(s: Column) -> Column:
    """Bytes of ``123``, ``123B``, ``2K``, ``3M`` or ``1G``; null for anything else, and for more than 63 bits."""
    n = F.regexp_extract(s, r"^([0-9]+)[GMKB]?$", 1).try_cast("bigint")
    unit = F.regexp_extract(s, r"^[0-9]+([GMKB]?)$", 1)
    return F.try_multiply(n, F.when(unit == "G", F.lit(1 << 30)).when(unit == "M", F.lit(1 << 20)).when(unit == "K", F.lit(1 << 10)).otherwise(F.lit(1)).cast("bigint"))


def parse_cache_dirs(s: Column) -> Column:
    """array<struct(size, path)> of ``size,path:size,path``; an entry without a comma has a null path."""
    part = lambda x, i: F.get(F.split(x, ",", 2), F.lit(i))
    return F.transform(split_parts(s, ":"), lambda x: F.struct(parse_size(part(x, 0)).alias("size"), part(x, 1).alias("path")))


def directory_weight(size: Column) -> Column:
    """Ring weight of a cache directory: one per 128 MiB, one at least."""
    return F.greatest(F.shiftright(size, 27), F.lit(1).cast("bigint"))


def parse_iso_time(s: Column) -> Column:
    """Timestamp of ``YYYY-MM-DDTHH:MM:SS.mmmZ`` without its milliseconds; null for other forms."""
    ok = s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$")
    return F.when(ok, F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def parse_bool(s: Column) -> Column:
    return (s == "1") | F.lower(s).isin("y", "yes", "true")


def percent_encode(s: Column) -> Column:
    return F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))


def percent_decode(s: Column) -> Column:
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def expected_path(path: Column, cwd: Column) -> Column:
    """Path without its extension, made absolute."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.when(bare.startswith("/"), bare).otherwise(F.concat(cwd, F.lit("/"), bare))


def result_name(suffix: Column, destination: Column) -> Column:
    """Name of a result file: the destination for ``.o``, else the destination's stem with the suffix."""
    return F.when(suffix == ".o", destination).otherwise(F.concat(F.regexp_replace(destination, r"\.o$", ""), suffix))


def compiler_root(path: Column, coverage: Column) -> Column:
    """Directory above ``/bin`` that must not show in results; empty for coverage builds, system compilers and others."""
    folder = directory_name(path)
    odd = coverage | folder.startswith("/usr/bin/") | folder.startswith("/opt/rh/") | ~folder.endswith("/bin")
    return F.when(odd, "").otherwise(F.regexp_replace(folder, "/bin$", ""))


def neutral_linemarkers(line: Column, root: Column, fake: str = "/opt/compiler-root") -> Column:
    """``# n "root/..."`` lines with the compiler's root replaced; other lines as they are."""
    at = F.regexp_extract(line, '^# [0-9]+ "(.*)"', 1)
    head = F.regexp_extract(line, '^(# [0-9]+ ")', 1)
    return F.when((root != "") & (head != "") & at.startswith(root), F.concat(head, F.lit(fake), F.substring(line, F.length(head) + F.length(root) + 1, F.length(line)))).otherwise(line)


def padded_workspace(base: Column, limit: int = PATH_MAX - 30) -> Column:
    """A directory below ``base`` that is made as long as paths may be."""
    return F.rpad(F.concat(base, F.lit("/")), limit, "A")
