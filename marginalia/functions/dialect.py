"""SQL text in the dialects of Spark and of DuckDB, for rules that are long lists of small text expressions.

A rule is a function of a dialect and of the text of its arguments. Spark parses the text with expr() and optimises it like
any other expression; a test or a user of the other engine gets the same rule without Python in between. Patterns
keep to what both engines read alike: no look-around, no back references.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence


class Spark:
    def text(self, value: str) -> str:
        return f"""r"{value}\"""" if "'" in value else f"r'{value}'"

    def sub(self, x: str, pattern: str, new: str = "") -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(new.replace(chr(92), '$'))})"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})"

    def group(self, x: str, pattern: str, n: int = 1) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {n})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.text(pattern)})"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)"

    def all_lower(self, x: str, pattern: str) -> str:
        """Matches in lower case, of a pattern for which a letter's case makes no difference.

        The text is put in lower case as a whole, except with letters where that isn't the same as match by match: the end of a word
        decides what becomes of one, another becomes two characters, and what patterns don't know yet can become a letter that they know.
        """
        alone = f"transform({self.all('all_of', pattern)}, x -> lower(x))"
        odd = lambda t: f"octet_length({t}) > length({t}) AND " + self.has(t, r"[Σİ\p{Cn}]")
        return self.let(x, lambda t: f"CASE WHEN {odd(t)} THEN {alone} ELSE {self.all(f'lower({t})', pattern)} END", "all_of")

    def each(self, array: str, rule: Callable[[str], str], x: str = "x") -> str:
        """x: the name of the element, for a rule within a rule."""
        return f"transform({array}, {x} -> {rule(x)})"

    def each_after(self, array: str, rule: Callable[[str, str], str]) -> str:
        """rule: of an element and the one before it, which is null for the first."""
        return f"transform({array}, (x, i) -> {rule('x', f'get({array}, i - 1)')})"

    def keep(self, array: str, test: Callable[[str], str], x: str = "x") -> str:
        return f"filter({array}, {x} -> {test(x)})"

    def let(self, value: str, rule: Callable[[str], str], name: str) -> str:
        """A rule of a value that is made once, under a name that no rule around it uses."""
        # As the last step of a fold over nothing, since what a transform() makes is copied, each word of a list too.
        return f"aggregate(array(), {value}, ({name}, x) -> {name}, {name} -> {rule(name)})"

    def holds(self, array: str, x: str) -> str:
        return f"array_contains({array}, {x})"

    def minus(self, a: str, b: str) -> str:
        """Of distinct elements those that b has not."""
        return f"array_except({a}, {b})"

    def common(self, a: str, b: str) -> str:
        """How many elements of a, repeated or not, b has: 0 or more."""
        return f"size(array_intersect({a}, {b}))"

    def lacking(self, a: str, b: str) -> str:
        """Distinct elements of a that b has not, in order of first mention."""
        return f"array_except({a}, {b})"

    def both(self, a: str, b: str) -> str:
        """Distinct elements of a that b has."""
        return f"array_intersect({a}, {b})"

    def once(self, array: str) -> str:
        """Distinct elements in order of first mention."""
        return f"array_distinct({array})"

    def chain(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def neighbours(self, array: str) -> str:
        """Structs a, b of each element and the next one."""
        return f"zip_with({self.first(array, f'greatest(size({array}) - 1, 0)')}, {self.rest(array)}, (x, y) -> named_struct('a', x, 'b', y))"

    def glued_neighbours(self, array: str, between: str = "") -> str:
        """Each element and the next one as one text; null of the last one."""
        parts = f"x, '{between}', y" if between else "x, y"
        return f"zip_with({array}, {self.rest(array)}, (x, y) -> concat({parts}))"

    def cuts(self, x: str, lengths: str) -> str:
        """A text cut in two, with a space between, in every way; where it is longer than 64, in those that leave a first part of one of these lengths."""
        at = f"CASE WHEN length({x}) <= 64 THEN sequence(1, length({x})) ELSE {lengths} END"
        return f"transform(filter({at}, n -> n < length({x})), n -> concat(substr({x}, 1, n), ' ', substr({x}, n + 1)))"

    def unstopped(self, x: str) -> str:
        """Without the full stops after single letters. The stop is looked for first, since a text has fewer of them than letters."""
        return self.sub(x, r"\.(?<=\b[A-Za-z]\.)")

    def flat(self, arrays: str) -> str:
        return f"flatten({arrays})"

    def array(self, items: Sequence[str]) -> str:
        return f"array({', '.join(items)})"

    def join(self, array: str, between: str) -> str:
        return f"array_join({array}, {self.text(between)})"

    def size(self, array: str) -> str:
        return f"coalesce(nullif(size({array}), -1), 0)"

    def at(self, array: str, n: int) -> str:
        """The n-th element, from the end if negative; null without it."""
        return f"try_element_at({array}, {n})"

    def first(self, array: str, n: str) -> str:
        return f"slice({array}, 1, {n})"

    def rest(self, array: str, start: str = "2") -> str:
        return f"slice({array}, {start}, greatest(size({array}), 1))"

    def glued(self, a: str, b: str) -> str:
        """Element by element one after the other."""
        return f"zip_with({a}, {b}, (x, y) -> x || y)"

    def rename(self, structs: str, fields: dict[str, str]) -> str:
        """Structs from structs: each field as an expression of x."""
        made = ", ".join(f"'{name}', {rule}" for name, rule in fields.items())
        return f"transform({structs}, x -> named_struct({made}))"


class Duck(Spark):
    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def sub(self, x: str, pattern: str, new: str = "") -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(new)}, 'g')"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def split(self, x: str, pattern: str) -> str:
        return f"string_split_regex({x}, {self.text(pattern)})"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)})"

    def all_lower(self, x: str, pattern: str) -> str:
        return self.each(self.all(x, pattern), lambda w: f"lower({w})")

    def each(self, array: str, rule: Callable[[str], str], x: str = "x") -> str:
        return f"list_transform({array}, lambda {x}: {rule(x)})"

    def each_after(self, array: str, rule: Callable[[str, str], str]) -> str:
        return f"list_transform({array}, lambda x, i: {rule('x', f'CASE WHEN i > 1 THEN {array}[i - 1] END')})"

    def keep(self, array: str, test: Callable[[str], str], x: str = "x") -> str:
        return f"list_filter({array}, lambda {x}: {test(x)})"

    def let(self, value: str, rule: Callable[[str], str], name: str) -> str:
        return f"list_transform([{value}], lambda {name}: {rule(name)})[1]"

    def holds(self, array: str, x: str) -> str:
        return f"list_contains({array}, {x})"

    def minus(self, a: str, b: str) -> str:
        return f"list_filter({a}, lambda m: NOT list_contains({b}, m))"

    def common(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def lacking(self, a: str, b: str) -> str:
        return self.once(self.minus(a, b))

    def both(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def once(self, array: str) -> str:
        return self.let(array, lambda a: f"list_filter({a}, lambda o, i: list_position({a}, o) = i)", "all_of")

    def chain(self, *arrays: str) -> str:
        return " || ".join(arrays)

    def neighbours(self, array: str) -> str:
        return f"list_transform(list_zip(({array})[1:len({array}) - 1], ({array})[2:]), lambda z: struct_pack(a := z[1], b := z[2]))"

    def glued_neighbours(self, array: str, between: str = "") -> str:
        return f"list_transform({self.neighbours(array)}, lambda z: z.a || '{between}' || z.b)"

    def cuts(self, x: str, lengths: str) -> str:
        return f"list_transform(range(1, greatest(length({x}), 2)), lambda cut: substr({x}, 1, cut) || ' ' || substr({x}, cut + 1))"

    def unstopped(self, x: str) -> str:
        return self.sub(x, r"\b([A-Za-z])\.", r"\1")

    def array(self, items: Sequence[str]) -> str:
        return f"[{', '.join(items)}]"

    def join(self, array: str, between: str) -> str:
        return f"array_to_string({array}, {self.text(between)})"

    def size(self, array: str) -> str:
        return f"coalesce(len({array}), 0)"

    def at(self, array: str, n: int) -> str:
        return f"({array})[{n}]"

    def first(self, array: str, n: str) -> str:
        return f"({array})[1:{n}]"

    def rest(self, array: str, start: str = "2") -> str:
        return f"({array})[{start}:]"

    def glued(self, a: str, b: str) -> str:
        return f"list_transform(list_zip({a}, {b}), lambda z: z[1] || z[2])"

    def rename(self, structs: str, fields: dict[str, str]) -> str:
        made = ", ".join(f"{name} := {rule}" for name, rule in fields.items())
        return f"list_transform({structs}, lambda x: struct_pack({made}))"


SPARK, DUCK = Spark(), Duck()


def with_steps(name: str, query: str, steps: Sequence[dict[str, str]]) -> str:
    """A chain of WITH parts for DuckDB: the query, then the columns of each step; the last part has the name."""
    parts, known = [f"{name}0 AS ({query})"], set()
    for i, step in enumerate(steps):
        again = ", ".join(f"({x}) AS {c}" for c, x in step.items() if c in known)
        more = "".join(f", {x} AS {c}" for c, x in step.items() if c not in known)
        parts.append(f"{name if i == len(steps) - 1 else f'{name}{i + 1}'} AS (SELECT *{f' REPLACE ({again})' if again else ''}{more} FROM {name}{i})")
        known |= set(step)
    return ",\n".join(parts)
