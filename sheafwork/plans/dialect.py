r"""One way to write a plan for Spark SQL and for the SQL engine it is compared with: the few functions whose spelling differs.

Patterns use what both engines share: no look-around, \p{L} classes, white space and word classes of ASCII.
"""

from ..functions.text import _accent_table

_FROM, _TO = _accent_table()


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, value: str) -> str:
        """A string literal."""
        if self.spark:
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + value.replace("'", "''") + "'"

    def pattern(self, p: str) -> str:
        return self.text(p)

    def array(self, values: list[str]) -> str:
        inner = ", ".join(self.text(v) for v in values)
        return f"array({inner})" if self.spark else f"[{inner}]"

    def like(self, x: str, p: str) -> str:
        return f"{'regexp_like' if self.spark else 'regexp_matches'}({x}, {self.pattern(p)})"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        """The first match, null where there is none."""
        return f"nullif(regexp_extract({x}, {self.pattern(p)}, {group}), '')"

    def extract_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, 0)"

    def count(self, x: str, p: str) -> str:
        return f"regexp_count({x}, {self.pattern(p)})" if self.spark else f"len({self.extract_all(x, p)})"

    def replace(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.text(by)})" if self.spark else f"regexp_replace({x}, {self.pattern(p)}, {self.text(by)}, 'g')"

    def split(self, x: str, p: str) -> str:
        return f"{'split' if self.spark else 'regexp_split_to_array'}({x}, {self.pattern(p)})"

    def filter(self, a: str, v: str, e: str) -> str:
        return f"filter({a}, {v} -> {e})" if self.spark else f"list_filter({a}, lambda {v}: {e})"

    def map(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})" if self.spark else f"list_transform({a}, lambda {v}: {e})"

    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"CAST(len({a}) AS INTEGER)"

    def any(self, a: str, v: str, e: str) -> str:
        return f"exists({a}, {v} -> {e})" if self.spark else f"len(list_filter({a}, lambda {v}: {e})) > 0"

    def how_many(self, a: str, v: str, e: str) -> str:
        return self.size(self.filter(a, v, e))

    def get(self, a: str, i: str) -> str:
        """Element from 1 on, null outside."""
        return f"get({a}, CAST({i} AS INT) - 1)" if self.spark else f"({a})[{i}]"

    def slice(self, a: str, begin: str, n: str) -> str:
        return f"slice({a}, CAST({begin} AS INT), CAST(greatest({n}, 0) AS INT))" if self.spark else f"list_slice({a}, {begin}, {begin} + greatest({n}, 0) - 1)"

    def upto(self, n: str) -> str:
        """1, 2, ... n; empty for 0."""
        return f"filter(sequence(0, CAST({n} AS INT)), i -> i > 0)" if self.spark else f"range(1, {n} + 1)"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.text(sep)})" if self.spark else f"array_to_string({a}, {self.text(sep)})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})" if self.spark else f"list_distinct({a})"

    def sort(self, a: str) -> str:
        return f"array_sort({a})" if self.spark else f"list_sort({a})"

    def trim(self, x: str) -> str:
        return f"trim({x})" if self.spark else f"trim({x}, ' ')"

    def squish(self, x: str) -> str:
        return self.trim(self.replace(x, r"[\s\x{A0}]+", " "))

    def norm(self, x: str) -> str:
        """Accents off, dashes and quotes in one form, lower case, trimmed."""
        bare = self.replace(x, r"[\x{300}-\x{36F}]", "")
        bare = f"translate({bare}, {self.text(_FROM)}, {self.text(_TO)})"
        marks = "‐‑‒–—―−‘’ʼ“” "
        return self.trim(f"lower(translate({bare}, {self.text(marks)}, {self.text('-------' + chr(39) * 3 + chr(34) * 2 + ' ')}))")

    def words(self, x: str, alternatives: str) -> str:
        """Whether one of the phrases (parted by |, as plain text) stands in lower-case text x as whole words."""
        return self.like(x, word_pattern(alternatives))

    def word_count(self, x: str) -> str:
        return self.count(x, WORD)

    def let(self, body, **values: str) -> str:
        """body(names...) with each value computed once: Spark would write a column into a lambda function that reads it, and so compute it for each element."""
        if not self.spark:
            return body(*values.values())
        text = body(*values)
        for name, value in reversed(values.items()):
            text = f"get(transform(array({value}), {name} -> {text}), 0)"
        return text

    def explode(self, a: str, value: str, number: str) -> str:
        """Select items: the elements of an array and their places from 0; an empty array may give a row without a place, which the plan drops.

        Spark would infer from a plain posexplode that the array isn't empty and push that test down through all the steps that make the array, written out in full.
        """
        return f"posexplode_outer({a}) AS ({number}, {value})" if self.spark else f"unnest({a}) AS {value}, generate_subscripts({a}, 1) - 1 AS {number}"

    def integer(self, x: str) -> str:
        return f"CAST({x} AS INT)" if self.spark else f"CAST({x} AS INTEGER)"

    def md5(self, x: str) -> str:
        return f"md5({x})"


WORD = r"[\p{L}\p{N}][\p{L}\p{N}+#./'-]*"


def word_pattern(alternatives: str) -> str:
    escaped = "|".join("".join("\\" + ch if ch in r"\.+*?()[]{}^$" else ch for ch in w) for w in alternatives.split("|"))
    return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{escaped})(?:$|[^\p{{L}}\p{{N}}])"


SPARK, OTHER = Dialect(True), Dialect(False)
