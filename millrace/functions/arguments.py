"""Compiler command lines: parsing, lookups and rewriting as column expressions over ``array<string>``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Options that take the next argument as their value.
ONE_VALUE = (
    "-o", "-x", "-dyld-prefix", "-gcc-toolchain", "--param", "--sysroot", "--system-header-prefix", "-target", "--assert",
    "--allowable_client", "-arch", "-arch_only", "-arcmt-migrate-report-output", "--prefix", "-bundle_loader", "-dependency-dot",
    "-dependency-file", "-dylib_file", "-exported_symbols_list", "--bootclasspath", "--CLASSPATH", "--classpath", "--resource",
    "--encoding", "--extdirs", "-filelist", "-fmodule-implementation-of", "-fmodule-name", "-fmodules-user-build-path",
    "-fnew-alignment", "-force_load", "--output-class-directory", "-framework", "-frewrite-map-file", "-ftrapv-handler", "-image_base",
    "-init", "-install_name", "-lazy_framework", "-lazy_library", "-meabi", "-mhwdiv", "-mllvm", "-module-dependency-dir",
    "-mthread-model", "-multiply_defined", "-multiply_defined_unused", "-rpath", "--rtlib", "-seg_addr_table",
    "-seg_addr_table_filename", "-segs_read_only_addr", "-segs_read_write_addr", "-serialize-diagnostics", "--serialize-diagnostics",
    "-std", "--stdlib", "--force-link", "-umbrella", "-unexported_symbols_list", "-weak_library", "-weak_reference_mismatches", "-B",
    "-D", "-U", "-I", "-i", "--include-directory", "-L", "-l", "--library-directory", "-MF", "-MT", "-MQ", "-cxx-isystem",
    "-c-isystem", "-idirafter", "--include-directory-after", "-iframework", "-iframeworkwithsysroot", "-imacros", "-imultilib",
    "-iprefix", "--include-prefix", "-iquote", "-include", "-include-pch", "-isysroot", "-isystem", "-isystem-after", "-ivfsoverlay",
    "-iwithprefix", "--include-with-prefix", "--include-with-prefix-after", "-iwithprefixbefore", "--include-with-prefix-before",
    "-iwithsysroot",
)

# Arguments that have no effect on a preprocessed source.
REMOTE_DROP = ("-MMD", "-MF", "-MD", "-MT", "-MP", "-o", "-Wmissing-include-dirs")
REMOTE_DROP_PREFIXES = ("-Wp,-MMD", "-Wp,-MF", "-Wp,-MD", "-Wp,-MP", "-I", "-include", "-isystem")


def parse(argv: Column) -> Column:
    """struct(options, files): each option with its value, if it takes one, and the remaining words as file names.

    Words are marked first, T if they take a value; then each T and the mark behind it, whichever that is, become O and V.
    """
    takes = F.transform(argv, lambda w: F.when(w.isin(*ONE_VALUE), "T").otherwise("-"))
    marks = F.split(F.regexp_replace(F.array_join(takes, ""), "T.", "OV"), "")
    after = F.slice(argv, F.lit(2), F.greatest(F.size(argv), F.lit(1)))
    words = F.filter(F.arrays_zip(argv.alias("word"), marks.alias("mark"), after.alias("next")), lambda x: x["mark"].isin("O", "T", "-"))
    is_option = lambda x: F.coalesce(x["word"].startswith("-"), F.lit(False))
    value = lambda x: F.when(x["mark"] == "O", F.array(x["next"])).otherwise(F.array().cast("array<string>"))
    options = F.transform(F.filter(words, is_option), lambda x: F.struct(x["word"].alias("opt"), value(x).alias("args")))
    files = F.transform(F.filter(words, lambda x: ~is_option(x)), lambda x: x["word"])
    return F.when(argv.isNotNull(), F.struct(options.alias("options"), files.alias("files")))


def lookup(options: Column, name: str, prefix: bool = False) -> Column:
    """First option of that name (or with that prefix) as struct(opt, args), null if there is none."""
    hit = lambda o: o["opt"].startswith(name) if prefix else o["opt"] == name
    return F.get(F.filter(options, hit), F.lit(0))


def has(options: Column, *names: str) -> Column:
    return F.exists(options, lambda o: o["opt"].isin(*names))


def words(options: Column) -> Column:
    """Options and their values as plain words again."""
    return F.flatten(F.transform(options, lambda o: F.concat(F.array(o["opt"]), o["args"])))


def rewrite(parsed: Column, drop: tuple[str, ...], drop_prefixes: tuple[str, ...], add: tuple[str, ...] = (), keep_files: bool = True) -> Column:
    """Words without the dropped options (by name or prefix, with their values), then additions and maybe the files."""

    def stays(o: Column) -> Column:
        gone = o["opt"].isin(*drop) if drop else F.lit(False)
        for p in drop_prefixes:
            gone = gone | o["opt"].startswith(p)
        return ~gone

    out = [words(F.filter(parsed["options"], stays)), F.array(*[F.lit(a) for a in add if a]).cast("array<string>")]
    return F.concat(*out, parsed["files"]) if keep_files else F.concat(*out)


def output_path(parsed: Column) -> Column:
    """The ``-o`` value, else the first file's base name with its extension replaced by ``.o``."""
    base = F.substring_index(F.get(parsed["files"], F.lit(0)), "/", -1)
    return F.coalesce(F.get(lookup(parsed["options"], "-o")["args"], F.lit(0)), F.concat(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit(".o")))


def language(parsed: Column) -> Column:
    """The ``-x`` value, else by file extension, else null."""
    f = F.get(parsed["files"], F.lit(0))
    by_name = F.when(f.endswith(".cc") | f.endswith(".cpp") | f.endswith(".cxx"), "c++").when(f.endswith(".c"), "c")
    return F.coalesce(F.get(lookup(parsed["options"], "-x")["args"], F.lit(0)), by_name)


def distributable(parsed: Column) -> Column:
    """Compilations that may run elsewhere: ``-c``, one C or C++ source, nothing from standard input, no assembly."""
    x = F.get(lookup(parsed["options"], "-x")["args"], F.lit(0))
    f = F.get(parsed["files"], F.lit(0))
    return has(parsed["options"], "-c") & F.coalesce(x.isin("c", "c++"), F.lit(True)) & ~has(parsed["options"], "-") & (F.size(parsed["files"]) == 1) & ~(f.endswith(".s") | f.endswith(".S"))


def lightweight(parsed: Column) -> Column:
    """Version queries and mere preprocessing."""
    return has(parsed["options"], "-dumpversion", "-dumpmachine", "-E")


def cacheable(argv: Column, source: Column) -> Column:
    """Whether a result may be kept: the source names no macro of the time, or the command line defines all of them."""
    macros = ("__TIME__", "__DATE__", "__TIMESTAMP__")
    defined = reduce(lambda a, b: a & b, [_defines(argv, m) for m in macros])
    return defined | ~reduce(lambda a, b: a | b, [source.contains(m) for m in macros])


def _defines(argv: Column, macro: str) -> Column:
    return F.exists(argv, lambda x: x.startswith(f"-D{macro}="))
