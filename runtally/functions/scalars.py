"""Scalar expressions. Every function takes and returns Columns and stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from runtally.schemas import CONTEXT_MAX_LENGTH, TRUE_WORDS, TRUE_WORDS_LINE

# Possessive runs: no backtracking, so a token of any length needs no deep recursion.
_QUOTED = r'"[^"]*+"|' + r"'[^']*+'"
_TOKEN = r'((?:[^ \t\r\n"' + r"']++|" + _QUOTED + ")++)"
_SEGMENT = r'([^"' + r"']++|" + _QUOTED + ")"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x, digits: int) -> Column:
    """Round half up after dropping binary noise beyond ten decimals."""
    return F.round(_c(x).cast("decimal(28,10)"), digits).cast("double")


def seconds_between(start, end) -> Column:
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(1_000_000.0)


def success() -> Column:
    return F.col("status") == "Success"


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, 0 when there is nothing to divide by."""
    return F.when(whole > 0, rounded(part / whole * 100, digits)).otherwise(F.lit(0.0))


# ---- JSON text --------------------------------------------------------------

def json_string(x) -> Column:
    """JSON string literal with everything outside printable ASCII escaped."""
    s = _c(x)
    units = F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("(.{4})"), 1)

    def unit(u: Column) -> Column:
        out = F.when(u == "0022", F.lit('\\"')).when(u == "005C", F.lit("\\\\"))
        for code, short in (("000A", "\\n"), ("000D", "\\r"), ("0009", "\\t"),
                            ("000C", "\\f"), ("0008", "\\b")):
            out = out.when(u == code, F.lit(short))
        printable = (u >= "0020") & (u <= "007E")
        return (out.when(printable, F.chr(F.conv(u, 16, 10).cast("int")))
                .otherwise(F.concat(F.lit("\\u"), F.lower(u))))

    body = F.when(s.rlike(r'^[ !#-\[\]-~]*$'), s).otherwise(
        F.array_join(F.transform(units, unit), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_entries(entries: Column) -> Column:
    """Array of key/value structs as a JSON object; NULL gives ``{}``."""
    pairs = F.transform(entries, lambda e: F.concat(
        json_string(e["key"]), F.lit(": "),
        F.coalesce(json_string(e["value"]), F.lit("null"))))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), F.lit("{}"))


def json_map(m, sort_keys: bool = False) -> Column:
    """Map as JSON text with ", " and ": " separators; NULL or empty gives ``{}``."""
    entries = F.map_entries(_c(m))
    return json_entries(F.array_sort(entries) if sort_keys else entries)


def json_strings(a) -> Column:
    """Array of strings as JSON text; NULL stays NULL."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(a), json_string), ", "), F.lit("]"))


def task_signature(instance, process, parameters, chore) -> Column:
    """First 16 hex digits of the SHA-256 of what a task runs."""
    is_chore = F.coalesce(_c(chore), F.lit("")) != ""
    text = F.when(
        is_chore, F.concat(F.lit("chore|"), _c(instance), F.lit("|"), _c(chore))
    ).otherwise(F.concat(
        _c(instance), F.lit("|"), F.coalesce(_c(process), F.lit("")), F.lit("|"),
        json_map(parameters, sort_keys=True)))
    return F.substring(F.sha2(text, 256), 1, 16)


# ---- key=value text ---------------------------------------------------------

def quotes_balanced(x) -> Column:
    return ~F.regexp_replace(_c(x), _QUOTED, "").rlike("[\"']")


def tokenize_line(x) -> Column:
    """Split on blanks; quotes group and vanish; a backslash is an ordinary character."""

    def unquote(seg: Column) -> Column:
        first = F.substring(seg, 1, 1)
        inner = seg.substr(F.lit(2), F.length(seg) - 2)
        # A single-quoted backslash comes out doubled in the established format.
        return (F.when(first == '"', inner)
                .when(first == "'", F.replace(inner, F.lit("\\"), F.lit("\\\\")))
                .otherwise(seg))

    return F.transform(
        F.regexp_extract_all(_c(x), F.lit(_TOKEN), 1),
        lambda tok: F.array_join(
            F.transform(F.regexp_extract_all(tok, F.lit(_SEGMENT), 1), unquote), ""))


def key_values(tokens: Column) -> Column:
    """``k=v`` tokens as an array of structs; tokens without ``=`` are left out."""
    return F.transform(
        F.filter(tokens, lambda t: t.contains("=")),
        lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"),
                           t.substr(F.instr(t, "=") + 1, F.length(t)).alias("value")))


def last_wins(pairs: Column) -> Column:
    """Array of key/value structs to a map; the last value of a repeated key counts."""
    def put(m: Column, p: Column) -> Column:
        changed = F.transform_values(m, lambda k, v: F.when(k == p["key"], p["value"]).otherwise(v))
        added = F.map_concat(m, F.map_from_arrays(F.array(p["key"]), F.array(p["value"])))
        return F.when(F.map_contains_key(m, p["key"]), changed).otherwise(added)

    unique = F.size(F.array_distinct(pairs["key"])) == F.size(pairs)
    return F.when(unique, F.map_from_entries(pairs)).otherwise(F.aggregate(pairs, empty_map(), put))


def empty_map() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def parse_params(x) -> Column:
    """Parameter text to a map: a JSON object, else ``k=v`` tokens, else empty."""
    s = F.trim(_c(x))
    as_json = F.when(s.rlike(r"(?s)^\{.*\}$"), F.from_json(s, "map<string,string>"))
    pairs = F.filter(key_values(tokenize_line(s)), lambda p: p["key"] != "")
    as_line = F.when(quotes_balanced(s), last_wins(pairs))
    return F.coalesce(as_json, as_line, empty_map())


def parse_bool(x, line: bool = False) -> Column:
    words = TRUE_WORDS_LINE if line else TRUE_WORDS
    return F.coalesce(F.lower(_c(x)).isin(*words), F.lit(False))


def predecessor_list(x, cube: bool = False) -> Column:
    """``"1,2"`` to an array. Task lines treat a leading ``0`` as none; cubes trim."""
    parts = F.split(F.coalesce(_c(x), F.lit("")), ",")
    if cube:
        return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    none = F.element_at(parts, 1).isin("", "0")
    return F.when(none, F.array().cast("array<string>")).otherwise(parts)


def positive_int_id(x) -> Column:
    return F.coalesce(_c(x).rlike("^[1-9][0-9]*$"), F.lit(False))


# ---- rendering --------------------------------------------------------------

def render_params(m) -> Column:
    """Map to ``k="v" k2="v2"`` in map order."""
    return F.coalesce(F.array_join(F.transform(F.map_entries(_c(m)), lambda e: F.concat(
        e["key"], F.lit('="'), F.coalesce(e["value"], F.lit("")), F.lit('"'))), " "), F.lit(""))


def render_param_sets(sets) -> Column:
    """Array of maps to their inline forms joined by ``; ``; empty ones are left out."""
    return F.array_join(F.filter(F.transform(_c(sets), render_params), lambda s: s != ""), "; ")


def format_duration(seconds) -> Column:
    s = _c(seconds)
    long = F.concat(F.floor(s / 60).cast("string"), F.lit("m "),
                    F.bround(s % 60, 0).cast("long").cast("string"), F.lit("s"))
    return F.when(s >= 60, long).otherwise(F.concat(F.format_string("%.1f", s), F.lit("s")))


def round_to_5(x) -> Column:
    return F.greatest(F.lit(5), (F.bround(_c(x) / 5.0, 0) * 5).cast("int"))


def safe_name(x) -> Column:
    return F.regexp_replace(_c(x), r"[^\p{L}\p{N}_-]", "_")


def session_context(workflow, exclusive, prefix: str = "Session") -> Column:
    """``Prefix_workflow`` or ``PrefixX_workflow``, cut to what a session field holds."""
    text = F.concat(F.lit(prefix), F.when(_c(exclusive), "X").otherwise(""), F.lit("_"),
                    F.coalesce(_c(workflow), F.lit("")))
    return F.substring(text, 1, CONTEXT_MAX_LENGTH)


def parse_session_context(context, prefix: str = "Session") -> Column:
    """Struct ``(exclusive, workflow)``, NULL for a foreign session."""
    c, pattern = _c(context), rf"^{prefix}(X?)_(.*)$"
    return F.when(c.rlike(pattern), F.struct(
        (F.regexp_extract(c, pattern, 1) == "X").alias("exclusive"),
        F.regexp_extract(c, pattern, 2).alias("workflow")))


def py_bool(x) -> Column:
    return F.when(F.coalesce(_c(x), F.lit(False)), "True").otherwise("False")


def task_line(with_graph: bool = False) -> Column:
    """Row of the task-definition schema to one ``key="value"`` line."""

    def kv(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'{key}="'), value, F.lit('"'))

    def when_true(key: str) -> Column:
        return F.when(F.coalesce(F.col(key), F.lit(False)), kv(key, F.lit("True")))

    is_chore = F.coalesce(F.col("chore"), F.lit("")) != ""
    proc_only = lambda c: F.when(~is_chore, c)
    instance = kv("instance", F.col("instance"))
    target = F.when(is_chore, kv("chore", F.col("chore"))).otherwise(
        kv("process", F.coalesce(F.col("process"), F.lit(""))))
    minor = proc_only(kv("succeed_on_minor_errors", py_bool("succeed_on_minor_errors")))
    stage = F.when(F.coalesce(F.col("stage"), F.lit("")) != "", kv("stage", F.col("stage")))
    optional = [when_true("safe_retry"), stage,
                proc_only(kv("timeout", F.col("timeout").cast("string"))),
                proc_only(when_true("cancel_at_timeout"))]
    params = proc_only(F.when(F.size("parameters") > 0, render_params("parameters")))
    if with_graph:
        preds = F.coalesce(F.array_join("predecessors", ","), F.lit(""))
        head = [kv("id", F.col("id")), kv("predecessors", preds),
                kv("require_predecessor_success", py_bool("require_predecessor_success")), minor]
        return F.concat_ws(" ", *head, *optional, instance, target, params)
    return F.concat_ws(" ", instance, target, minor, *optional, params)


def fan_out_key(parameters, keys) -> Column:
    """Values of ``keys`` (array column) in key order, joined by ``|``."""
    m = _c(parameters)
    return F.array_join(F.transform(F.array_sort(_c(keys)), lambda k: F.coalesce(m[k], F.lit(""))), "|")


def short_label(x, longest: int, keep: int) -> Column:
    s = _c(x)
    return F.when(F.length(s) > longest, F.concat(F.substring(s, 1, keep), F.lit("..."))).otherwise(s)


def natural_key(x) -> Column:
    """Sort key: numbers by value first, then text prefix and first number; numbers of any length.

    A number is compared by how many digits it has and then by its digits as text, which are turned
    round for negative ones.
    """
    s = _c(x)
    canonical = s.rlike(r"^(0|-?[1-9][0-9]*)$")
    below = s.startswith("-")
    size = F.when(below, 1 - F.length(s)).otherwise(F.length(s))
    first = F.regexp_extract(s, r"^\D*([0-9]+)", 1)
    value = F.when(first != "", F.ltrim(first, F.lit("0")))
    return F.struct(
        F.when(canonical, 0).otherwise(1).alias("kind"),
        F.when(canonical, size).alias("digits"),
        F.when(canonical, F.when(below, F.translate(s, "0123456789", "9876543210")).otherwise(s)).alias("number"),
        F.lower(F.regexp_extract(s, r"^(\D*)", 1)).alias("prefix"),
        F.length(value).alias("first_digits"), value.alias("first"),
        s.alias("text"))


def target_of() -> list[Column]:
    """``task_target`` and ``task_kind`` of a task row."""
    chore = F.coalesce(F.col("chore"), F.lit(""))
    return [
        F.when(chore != "", chore).otherwise(F.coalesce(F.col("process"), F.lit(""))).alias("task_target"),
        F.when(chore != "", "chore").otherwise("process").alias("task_kind"),
    ]
