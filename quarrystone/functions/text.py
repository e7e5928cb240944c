"""Column functions over text: normal forms, cleaners, extractors and classifiers, all on the JVM."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BANNED_DOMAINS, DISCRIMINATORS, GENERIC_URLS, MISSING_ENTITY, NAME_PATTERNS, NOT_SPECIFIED, NOT_SPECIFIED_MARKERS, OUT_OF_SCOPE_NAMES, OUT_OF_SCOPE_SUFFIXES, PAPER_DOMAINS, PROJECTS, STOP_WORDS

URL = r"https?://[^\s'\"\])>,]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit(""))


def strip(x: Column | str) -> Column:
    """Without white space at either end, all of Unicode's."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def normalize(x: Column | str) -> Column:
    """Lower case, white space collapsed; null as the empty text."""
    return strip(F.regexp_replace(F.lower(text_or_empty(x)), r"(?U)\s+", " "))


def or_not_specified(x: Column | str) -> Column:
    """Stripped text, missing markers as ``not specified``."""
    s = strip(text_or_empty(x))
    return F.when(F.lower(s).isin(*NOT_SPECIFIED_MARKERS), NOT_SPECIFIED).otherwise(s)


def compact_key(x: Column | str) -> Column:
    """Letters and digits of a name without file suffixes and cell marks."""
    s = F.lower(text_or_empty(x))
    for part in (".csv", ".txt", " (telemetry)", " (c)"):
        s = F.replace(s, F.lit(part), F.lit(""))
    return F.regexp_replace(s, "[^a-z0-9]", "")


def mapped_key(x: Column | str, mapping: dict[str, str]) -> Column:
    """Compact key after a rename of the lower-cased, stripped name."""
    s = strip(F.lower(text_or_empty(x)))
    pairs = [F.lit(y) for k, v in mapping.items() for y in (k.lower().strip(), v)]
    return compact_key(F.coalesce(F.try_element_at(F.create_map(*pairs), s), s))


def alphanumeric(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(x)), "[^a-z0-9]", "")


def is_missing(x: Column | str, markers: tuple[str, ...]) -> Column:
    return text_or_empty(x).isin(*markers)


def clean_name(x: Column | str) -> Column:
    """Name without brackets and empty words, words joined by spaces; empty for missing markers."""
    s = strip(F.lower(text_or_empty(x)))
    words = F.split(F.regexp_replace(s, r"\(.*?\)", ""), r"(?U)[\s_\-]+")
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & w.rlike(r"^[\p{L}\p{N}]+$"))
    return F.when(s.isin(*MISSING_ENTITY), "").otherwise(F.array_join(kept, " "))


def first_integer(x: Column | str) -> Column:
    """First run of digits, commas dropped; -1 where there is none."""
    s = F.replace(strip(F.lower(text_or_empty(x))), F.lit(","), F.lit(""))
    return F.coalesce(F.regexp_extract(s, "[0-9]+", 0).try_cast("bigint"), F.lit(-1).cast("bigint"))


def clean_url(x: Column | str) -> Column:
    s = F.lower(strip(text_or_empty(x)))
    bare = F.regexp_replace(s, r"^[\['\"]+|[\]'\"]+$", "")
    return F.when(s.isin(*MISSING_ENTITY), "").otherwise(F.regexp_replace(F.substring_index(bare, "?", 1), "/+$", ""))


def is_generic_url(x: Column | str) -> Column:
    """Too short, or on a host that many entities share."""
    u = text_or_empty(x)
    return (F.length(u) < 15) | reduce(lambda a, b: a | b, [u.contains(g) for g in GENERIC_URLS])


def distinct_variants(a: Column | str, b: Column | str) -> Column:
    """Whether two names must be different variants: short names, trailing numbers, discriminators."""
    a, b = strip(F.lower(text_or_empty(a))), strip(F.lower(text_or_empty(b)))
    number = lambda x: F.regexp_extract(x, "([0-9]+)$", 1)
    stem = lambda x: strip(F.regexp_replace(x, "[0-9]+$", ""))
    marks = lambda x: F.array_sort(F.array_intersect(F.array(*map(F.lit, DISCRIMINATORS)), F.regexp_extract_all(x, F.lit("([a-z0-9]+)"))))
    short = (F.length(a) <= 6) & (F.length(b) <= 6)
    numbered = (number(a) != "") & (number(b) != "") & (number(a) != number(b)) & (stem(a) == stem(b))
    return (a != b) & (short | numbered | (marks(a) != marks(b)))


def in_scope(x: Column | str) -> Column:
    """Whether a name can be a dataset: not empty, no file, none of the static ones."""
    s = F.lower(text_or_empty(x))
    out = [s.endswith(e) for e in OUT_OF_SCOPE_SUFFIXES] + [s.contains(n) for n in OUT_OF_SCOPE_NAMES]
    return (s != "") & ~reduce(lambda a, b: a | b, out)


def standard_name(x: Column | str) -> Column:
    """Name without owners, notes in brackets and sizes; as it was where two characters or fewer are left."""
    s = text_or_empty(x)
    new = s
    for p in NAME_PATTERNS:
        new = strip(F.regexp_replace(new, f"(?i){p}", ""))
    new = F.regexp_replace(new, "^[-_ ]+|[-_ ]+$", "")
    return F.when(F.length(new) > 2, new).otherwise(s)


def is_banned_url(x: Column | str) -> Column:
    s = F.lower(text_or_empty(x))
    return reduce(lambda a, b: a | b, [s.contains(d) for d in BANNED_DOMAINS])


def is_paper_url(x: Column | str) -> Column:
    s = F.lower(text_or_empty(x))
    return reduce(lambda a, b: a | b, [s.contains(d) for d in PAPER_DOMAINS])


def tidy_url(x: Column | str, strip_brackets: bool = False) -> Column:
    """Target of a markdown link, or the first URL of several, without punctuation behind it."""
    s = strip(text_or_empty(x))
    if strip_brackets:
        s = F.regexp_replace(s, r"^[\[\]'\"]+|[\[\]'\"]+$", "")
    s = F.replace(F.replace(s, F.lit("', '"), F.lit(", ")), F.lit('", "'), F.lit(", "))
    link = F.regexp_extract(s, r"\[.*?\]\((https?://.*?)\)", 1)
    first = F.regexp_extract(s, r"(https?://[^\s]+)", 1)
    s = F.when(link != "", link).when(s.startswith("http") & s.contains(" ") & (first != ""), first).otherwise(s)
    return F.regexp_replace(s, r"[.,;:'\"\]>)]+$", "")


def urls_of(x: Column | str) -> Column:
    """URLs of a text, those of markdown links first, each once."""
    s = text_or_empty(x)
    return F.array_union(F.regexp_extract_all(s, F.lit(r"\[.*?\]\((https?://[^\s)]+)\)")), F.regexp_extract_all(s, F.lit(f"({URL})")))


def hyperlink_urls(x: Column | str) -> Column:
    """A formula's link targets, ordered, each once, joined by commas; other text as it is."""
    s = text_or_empty(x)
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(r'(?i)HYPERLINK\("([^"]+)"')))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(s)


def hyperlink_label(x: Column | str) -> Column:
    s = strip(text_or_empty(x))
    label = F.regexp_extract(s, r'(?i)=HYPERLINK\([^,]+,\s*"([^"]+)"\)', 1)
    return F.when(label != "", label).otherwise(s)


def guard_formula(x: Column | str) -> Column:
    """A quote before text that a sheet would take for a formula; links stay."""
    s = text_or_empty(x)
    return F.when(s.rlike(r"^\s*[=+\-@]") & ~s.rlike(r"(?i)^=HYPERLINK\("), F.concat(F.lit("'"), s)).otherwise(s)


def text_or_missing(x: Column | str) -> Column:
    return F.coalesce(F.nullif(strip(text_or_empty(x)), F.lit("")), F.lit("[missing]"))


def strip_fences(x: Column | str) -> Column:
    """Text without a code fence around it."""
    s = strip(text_or_empty(x))
    return F.when(s.startswith("```"), strip(F.regexp_replace(F.regexp_replace(s, "^```(json)?", ""), "```$", ""))).otherwise(text_or_empty(x))


def squeeze(x: Column | str) -> Column:
    """Runs of spaces as one, of three and more line feeds as two."""
    return F.regexp_replace(F.regexp_replace(text_or_empty(x), "[ \t]+", " "), "\n{3,}", "\n\n")


def file_name_part(x: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(x), r"[^A-Za-z0-9_\-]", "_")


def sheet_id(x: Column | str) -> Column:
    s = text_or_empty(x)
    found = F.regexp_extract(s, r"/d/([A-Za-z0-9_\-]+)", 1)
    return F.when(found != "", found).otherwise(s)


def arxiv_id(x: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(x), r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})", 1)


def capitalized(x: Column | str) -> Column:
    """First letter upper case, all others lower."""
    s = text_or_empty(x)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def frequency(x: Column | str) -> Column:
    """Sampling frequency named in a text, null where none is."""
    s = F.lower(text_or_empty(x))
    every = F.regexp_extract(s, r"every\s+([0-9]+\s*(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?))", 1)
    number = F.regexp_extract(s, r"([0-9]+)[\s-]*(second|minute|hour|day|week|month|year)", 0)
    word = F.regexp_extract(s, r"\b(hourly|daily|weekly|monthly|quarterly|yearly|annual)\b", 1)
    found = F.coalesce(*[F.nullif(v, F.lit("")) for v in (every, number, word)])
    return F.when(found.isNotNull(), capitalized(found))


def _ordered(s: Column, cases: list[tuple[Column, str]], default: str) -> Column:
    out = F
    for condition, label in cases:
        out = out.when(condition, label)
    return out.otherwise(default)


def any_of(s: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(p) for p in parts], F.lit(False))


def model_of_file(x: Column | str) -> Column:
    """Model family by file name; the order of the tests matters."""
    s = F.lower(text_or_empty(x))
    cases = [
        (any_of(s, ("pro", "monolithic")), "Cloud-Pro"),
        (any_of(s, ("flash", "cascade", "consolelog")), "Cloud-Flash"),
        (any_of(s, ("deepseek", "r1")), "DeepSeek"),
        (s.contains("qwen"), "Qwen"),
        (s.contains("gemma"), "Gemma"),
    ]
    return _ordered(s, cases, "Unknown")


def context_of_file(x: Column | str, model: Column | str) -> Column:
    """Context length by file name, sizes of models taken out first."""
    s = F.regexp_replace(F.lower(text_or_empty(x)), r"(32|31|27|14|7|70|1\.5)b", "")
    cases = [(col(model).isin("Cloud-Pro", "Cloud-Flash"), "Cloud"), (any_of(s, ("131", "128", "titan")), "131K"), (any_of(s, ("65", "64")), "64K"), (s.contains("32"), "32K")]
    return _ordered(s, cases, "Unknown")


def project_of_file(x: Column | str) -> Column:
    s = F.upper(text_or_empty(x))
    cases = [(s.contains("KAG"), "KAGGLETS")]
    cases += [(s.contains(p) & ~s.contains("M6") if p == "M2" else s.contains(p), p) for p in PROJECTS]
    return _ordered(s, cases, "Unknown")


def stamp_of_file(x: Column | str) -> Column:
    """``YYYYMMDD_HHMM`` of a file name, zeros where it has none."""
    found = F.regexp_extract(text_or_empty(x), "([0-9]{8}_[0-9]{4})", 1)
    return F.when(found != "", found).otherwise("00000000_0000")


def time_of_file(x: Column | str) -> Column:
    return F.try_to_timestamp(stamp_of_file(x), F.lit("yyyyMMdd_HHmm")).cast("timestamp_ntz")


def run_of_file(x: Column | str) -> Column:
    """Run number: named in the file's path, else by its date."""
    s, name = F.lower(text_or_empty(x)), F.regexp_extract(F.lower(text_or_empty(x)), "([^/]*)$", 1)
    month = F.regexp_extract(name, "202[6-9]([0-9]{2})([0-9]{2})_[0-9]{4}", 1).try_cast("int")
    day = F.regexp_extract(name, "202[6-9]([0-9]{2})([0-9]{2})_[0-9]{4}", 2).try_cast("int")
    return (
        F.when(any_of(s, ("run3", "recovery")), 3).when(s.contains("run2"), 2).when(s.contains("run1"), 1)
        .when((month == 7) & (day >= 9), 3).when((month == 7) & day.isin(7, 8), 2).otherwise(1)
    )


def file_type(x: Column | str) -> Column:
    """Class of a file in the run inventory."""
    s = F.lower(text_or_empty(x))
    cases = [
        (s.contains("vram") & s.endswith(".csv"), "VRAM CSV"),
        (s.contains("checkpoint") & s.endswith(".csv"), "Checkpoint CSV"),
        (s.endswith(".csv"), "Data CSV"),
        (s.endswith(".log"), "Log"),
        (s.endswith(".txt"), "TXT-Log"),
    ]
    return _ordered(s, cases, "Other")


def is_console_file(x: Column | str) -> Column:
    """Whether a file comes from a cloud console, by its name."""
    return any_of(F.lower(text_or_empty(x)), ("cloud", "cascade", "monolithic", "consolelog"))


@dataclass(frozen=True)
class Workspace:
    """How the files of a workspace are named, all in lower case; every workspace gives its own lists."""

    #: Words of administrative files, and of files that may go.
    admin_words: tuple[str, ...] = ()
    spent_words: tuple[str, ...] = ()
    #: Endings, words and whole names of files that stay where they are.
    kept_endings: tuple[str, ...] = (".py", ".sh", ".json", ".ipynb", ".md", ".zip")
    kept_words: tuple[str, ...] = ()
    kept_files: tuple[str, ...] = ()
    #: Projects whose runs are filed, and folders with the words that lead to them, in order of precedence.
    projects: tuple[str, ...] = ()
    folders: tuple[tuple[str, tuple[str, ...]], ...] = ()


def is_admin_file(x: Column | str, w: Workspace) -> Column:
    """Whether a file name is an administrative one: no console file, and of no project, a script or with a word of those."""
    s = F.lower(text_or_empty(x))
    homeless = (project_of_file(x) == "Unknown") & ~text_or_empty(x).startswith("Bench_")
    script = reduce(lambda a, b: a | b, [s.endswith(e) for e in (".py", ".sh", ".json", ".md")])
    return ~is_console_file(x) & (homeless | script | any_of(s, w.admin_words))


def workspace_folder(x: Column | str, w: Workspace) -> Column:
    """Where a workspace file belongs by its name: Ignored, VRAM, Trash_Bin, a folder of the workspace's or run1, the first that holds."""
    s = F.lower(text_or_empty(x))
    ends = lambda endings: reduce(lambda a, b: a | b, [s.endswith(e) for e in endings], F.lit(False))
    # Short names of projects count as whole parts of a name only.
    runs = reduce(lambda a, b: a | b, [s.contains(f"_{p}_") | s.startswith(f"{p}_") for p in w.projects if len(p) == 2], F.lit(False))
    cases = [
        (ends(w.kept_endings) | s.isin(*w.kept_files) | any_of(s, w.kept_words), "Ignored"),
        (s.contains("vram") & s.endswith(".csv"), "VRAM"),
        (any_of(s, w.spent_words) | ~ends((".csv", ".log", ".txt")), "Trash_Bin"),
        *[(any_of(s, words), folder) for folder, words in w.folders],
        (runs | any_of(s, [p for p in w.projects if len(p) > 2]), "run1"),
    ]
    return _ordered(s, cases, "Trash_Bin")


def is_run_file(x: Column | str, w: Workspace) -> Column:
    """Whether a file name has the prefix of a project's runs."""
    s = F.lower(text_or_empty(x))
    return reduce(lambda a, b: a | b, [s.startswith(f"{p}_") for p in ("bench", *w.projects)])


def parsed_time(x: Column | str) -> Column:
    """A text as a time, by the first format that it has; null where it has none."""
    s = strip(text_or_empty(x))
    formats = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "yyyyMMdd_HHmm", "yyyyMMdd")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def head_of(x: Column | str, n: int) -> Column:
    """The first ``n`` characters of a text."""
    return F.substring(text_or_empty(x), 1, n)


def project_in_text(x: Column | str, within: int = 50_000) -> Column:
    """Project that the head of a log names."""
    mark = r"(?i)(?:Processing Project|STARTING PROJECT|Project|STARTING:.*?\|\s*Project):\s*([A-Za-z0-9_]+)"
    found = F.regexp_extract(head_of(x, within), mark, 1)
    return F.when(found == "", "Unknown").otherwise(project_of_file(found))


def fill_template(template: Column | str, name: Column | str) -> Column:
    return F.replace(text_or_empty(template), F.lit("{name}"), text_or_empty(name))


def tidy_cell(x: Column | str) -> Column:
    """Cell of a report's table without emphasis and notes in brackets."""
    s = F.regexp_replace(F.regexp_replace(text_or_empty(x), r"\*\*|__", ""), r"^[\s*_]+|[\s*_]+$", "")
    for p in NAME_PATTERNS[5:10]:
        s = strip(F.regexp_replace(s, f"(?i){p}", ""))
    return s


def plain_query(x: Column | str) -> Column:
    return strip(F.regexp_replace(text_or_empty(x), r"\*\*|__", ""))


def simple_query(x: Column | str) -> Column:
    """Search words of a query without operators, sites, commands before and requests behind."""
    s = F.regexp_replace(F.replace(text_or_empty(x), F.lit('"'), F.lit("")), " (OR|AND) ", " ")
    s = F.regexp_replace(s, r"site:\S+", "")
    s = F.regexp_replace(s, r"(?i)^(Look for|Search for|Find|Identify|Locate)\s+", "")
    return strip(F.regexp_replace(s, r"(?i)\s+(with its attributes|with attributes|and provide|details about).*$", ""))
