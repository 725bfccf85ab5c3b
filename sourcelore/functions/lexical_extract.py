"""Facts of JavaScript and TypeScript files from comment- and string-aware patterns.

Three texts are derived from a file, each once:

``code``  comments and regular-expression literals removed, strings kept; files with code inside
          templates or with JSX are read token by token for it (``modes``);
``bare``  as ``code`` with string contents blanked, except one-word strings, which no
          pattern here can mistake for code and which object keys need;
``flat``  ``bare`` with what stands in brackets taken out, innermost first, and set behind the
          rest, a mark left in its place; so commas and equal signs of a statement are its own.

In ``bare`` white space is one space, or one line end where it holds any, so that what stands
before a word is at most one character of white space away, however far a line is indented.

Quantifiers over unbounded text are possessive or single-character: alternations
repeated in a group recurse on the JVM and overflow its stack on long texts.

Limits: regular-expression literals after an unusual token, and type parameters nested more
than eight deep, are not seen as a syntax tree would see them.
"""

from __future__ import annotations

from .modes import plain_code
from .sqltext import NO_NAMES, captures, case, literal, names, regex_matches

STRINGS = r""""(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\])*+`"""
# With what stands before it, which tells it from a division.
REGEX_LITERAL = r"([=(,:\[!&|?{};]\s*+|return(?<![\w$.]return)\s++)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/[a-z]*+"

# A pattern is tried at every position of a text. Those below start with a literal, which the
# matcher searches for, or with the set of their first characters; what must not stand
# before is checked behind that, as "not preceded by X, then the literal".

# What `code` drops (comments, regex literals); strings are matched first-come and kept. A comment
# that is never closed goes to the end of the text, where a parser would report it.
NOISE = rf"(?s)(?=[/\"'`=(,:\[!&|?{{}};r])(?://[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?+|({STRINGS})|{REGEX_LITERAL})"
# What `bare` blanks; one-word strings keep their quotes and text.
QUOTED = rf"(?s)(?=[\"'`])(?:(['\"])([\w$.-]++)\1|{STRINGS})"
BLANKS = r"[^\S\n]++"
LINE_ENDS, LINE_END = r" ?\n(?: ?\n)*+ ?", "\n"
NO_BRACKET = r"[^{}()\[\]]++"
PAIR, OPENING = r"[{(\[][})\]]", r"[{(\[]"
NAME = r"([\w$]+)"


def _word(word: str) -> str:
    """A word that is not the end of a longer name or a member."""
    return rf"{word}(?<![\w$.]{word})"


def _declared(word: str) -> str:
    """A word that starts a declaration: as a value, a function or class is an expression."""
    return rf"{_word(word)}(?<![=(,:?&|!\[]\s?(?:async\s)?{word})(?<!\breturn\s(?:async\s)?{word})"


IMPORTS = (
    # `import x = require()` is a declaration of its own kind, not a call.
    r"(?s)(?=[ier\"'`])(?:(?<![\w$.])import\s++[\w$]++\s*+=\s*+require\s*+\(\s*+['\"][^'\"\n]*+['\"]"
    rf"|(?<![\w$.])(?:import\s++(?!type\s++(?!from\s*['\"]))[^'\"();]*?from\s*+"
    r"|export\s++(?:type\s++)?(?:\*|\{)[^'\"();]*?from\s*+"
    rf"|import\s*+\(\s*+|require\s*+\(\s*+|import\s*+)['\"]([^'\"\n]+)['\"]|{STRINGS})"
)
FUNCTIONS = rf"{_declared('function')}\s*+\*?\s*+{NAME}"
# What may introduce a name that a function bears.
INTRODUCED = rf"(?:function\s?\*?\s?|(?:const|let|var)\s|,\s?){NAME}"
CLASSES = rf"{_declared('class')}\s++(?!extends\b){NAME}"
INTERFACES = rf"{_word('interface')}\s++{NAME}"

EXPORT = _word("export")
EXPORTED_DECLARATION = (
    rf"{EXPORT}\s++(?:declare\s++)?(?:(?:async\s++)?function\s*+\*?\s*+|(?:abstract\s++)?class\s++"
    rf"|interface\s++|type\s++(?=[\w$]+\s*+[=<])){NAME}"
)
EXPORTED_LIST = rf"{EXPORT}\s*+(?:type\s*+)?\{{([^}}]*+)\}}"
VARIABLE_NAME = rf"(?s)^\s*+{NAME}\s*+(?:$|[:=!])"

# Marks of what was taken out of a flat text, and of the arrow, which is no equal sign there.
FOLDED, ARROW = "\u0002", "\u0003"
# What may stand in one declarator of a flat text: a line ends it unless the statement must go on.
_GOES_ON = rf"\n(?=[.?:=|&+*%<>{ARROW}-])|(?<=[=+*%|&?:<>{ARROW}-])\n"
_DECLARATOR = rf"(?:[^,;\n(){{}}\[\]]|{_GOES_ON})*+"
VARIABLES = rf"{_word('(?:const|let|var)')}\s++({_DECLARATOR}(?:\s?,\s?{_DECLARATOR})*+)"
EXPORTED_VARIABLES = rf"{EXPORT}\s++(?:declare\s++)?(?:const|let|var)\s++({_DECLARATOR}(?:\s?,\s?{_DECLARATOR})*+)"
VARIABLE_FUNCTION = (
    rf"(?s)^\s*+{NAME}\s?!?\s?(?::[^=]*+)?=\s?(?:async(?![\w$])\s?)?"
    rf"(?:function(?![\w$])|{FOLDED}\s?(?::[^={ARROW}]*+)?{ARROW}|[\w$]++\s?{ARROW})"
)
# Type parameters and arguments, two levels at a time: behind a name, or before the parameters of an arrow function.
_TYPES = r"(?:[^<>;&|]|&(?!&)|\|(?!\|))*+"
TYPE_LIST = rf"<(?:(?<=[\w${FOLDED}]<)|(?<=[=(,:]\s?<)|(?<=async\s<)){_TYPES}(?:<{_TYPES}>{_TYPES})*+>(?=\s?[{FOLDED}=,;:)|&\n.>\[]|$)"
TYPE_PASSES = 4
LISTED_NAME = rf"(?s)^\s*+(?:.*\sas\s++|type\s++(?!as\s))?['\"]?{NAME}['\"]?\s*+$"
EXPORTED_NAMESPACE = rf"{EXPORT}\s*+\*\s*+as\s++{NAME}"
EXPORT_ALL = rf"{EXPORT}\s*+(?:type\s++)?\*\s*+from(?![\w$])"
EXPORT_DEFAULT = rf"{EXPORT}\s++default(?![\w$])"

# `module.exports =`, and TypeScript's `export =`.
ASSIGNED = r"export(?:s(?<=(?<![\w$.])module\.exports)|(?<![\w$.]export))\s*+=(?![=>])\s*+"
ASSIGNED_NAME = rf"{ASSIGNED}(?!function(?![\w$])|class(?![\w$])|async(?![\w$])|new\s|await\s|typeof\s){NAME}[ \t]*+(?:[;,)\n\r}}]|$)"
ASSIGNED_DEFINITION = rf"{ASSIGNED}(?:async\s++)?(?:function\s*+\*?\s*+|class\s++)(?!extends\b){NAME}"
ASSIGNED_OBJECT = rf"{ASSIGNED}\{{"
MEMBER = (
    rf"exports\.(?:(?<![\w$.]exports\.)|(?<=(?<![\w$.])module\.exports\.)){NAME}(?:\.[\w$]+)*+"
    r"\s*+(?:[-+*/%&|^]|&&|\|\||\?\?)?=(?![=>])"
)

# `exports['x']` is `exports.x`.
BRACKETED = r"\[(?<=(?<![\w$])(?:exports|module)\[)\s?(['\"])([\w$]++)\1\s?\]"

# Before an object that is assigned as the module's exports.
OPENED = "\u0001"


def _bracketed(levels: int) -> str:
    """Brackets with at most so many levels of brackets in them, themselves counted."""
    inside = NO_BRACKET.replace("++", "*+")
    return rf"[{{(\[]{inside}(?:{_bracketed(levels - 1)}{inside})*+[}})\]]" if levels > 1 else rf"[{{(\[]{inside}[}})\]]"


#: Levels of brackets that are taken out of a text at a time, to be taken apart when none deeper are left.
LEVELS = 8
OBJECT_BODY = rf"{OPENED}\{{([^{{}}\[\]()]*+)\}}"
OBJECT_KEY = rf"(?s)^\s*+(?:(?:async|get|set|static)\s++(?=[\w$'\"*]))?\*?\s*+['\"]?{NAME}['\"]?\s*+(?:[:{FOLDED}=].*+)?$"


def code_text(content: str, jsx: str = "true") -> str:
    return f"regexp_replace({plain_code(content, jsx)}, {literal(NOISE)}, '$1$2 ')"


def bare_text(code: str) -> str:
    blanked = f"regexp_replace({code}, {literal(QUOTED)}, '$1$2$1')"
    narrow = f"regexp_replace({blanked}, {literal(BLANKS)}, ' ')"
    lines = f"regexp_replace({narrow}, {literal(LINE_ENDS)}, {literal(LINE_END)})"
    return f"regexp_replace({lines}, {literal(BRACKETED)}, '.$2')"


def nesting(text: str) -> str:
    """How deep the brackets of a text nest; ``LEVELS`` if they are all closed and nest no deeper."""
    # Each round takes the innermost level; counting bracket by bracket costs ten times that, and few texts are so deep.
    shallow = f"aggregate(array_repeat(0, {LEVELS}), brackets, (b, _) -> if(b = '', b, regexp_replace(b, {literal(PAIR)}, '')))"
    brackets = f"regexp_replace({text}, {literal(NO_BRACKET)}, '')"
    counted = f"if({shallow} rlike {literal(OPENING)}, {_counted_levels('brackets')}, {LEVELS})"
    return f"element_at(transform(array({brackets}), brackets -> {counted}), 1)"


def _counted_levels(brackets: str) -> str:
    """How deep a text of nothing but brackets nests."""
    each = f"split({brackets}, '')"
    step = """(s, b) -> case when b in ('{', '(', '[') then struct(s.at + 1 as at, greatest(s.most, s.at + 1) as most)
      when b <> '' then struct(greatest(s.at - 1, 0) as at, s.most as most) else s end"""
    return f"aggregate({each}, struct(0 as at, 0 as most), {step}, s -> s.most)"


def _taken_out(text: str, levels: int, times: str) -> str:
    """The text with a mark for each bracket, and behind it these brackets, after so many rounds."""
    pattern = literal(f"{OPENED}?+{_bracketed(levels)}")
    taken = f"""struct(regexp_replace(s.rest, {pattern}, '{FOLDED}') as rest, concat(s.parts, found) as parts, size(found) = 0 as done)"""
    # Depth is the most there can be, so rounds may be left when there is nothing left to take out.
    step = f"""(s, _) -> if(s.done, s, element_at(transform(array(regexp_extract_all(s.rest, {pattern}, 0)), found -> {taken}), 1))"""
    start = f"struct({text} as rest, cast(array() as array<string>) as parts, false as done)"
    return f"aggregate(array_repeat(0, {times}), {start}, {step}, s -> array_join(concat(array(s.rest), s.parts), ';\n'))"


def flat_text(bare: str) -> str:
    """What stands in brackets, one after the other, behind what stands in none.

    Deep brackets are taken out several levels at a time, so that a text is not read again for each of its levels.
    """
    opened = f"regexp_replace({bare}, {literal(ASSIGNED_OBJECT)}, '{OPENED}{{')"
    coarse = _taken_out(opened, LEVELS, f"if(depth <= {LEVELS}, 0, cast(ceil(depth / {LEVELS}) as int))")
    fine = _taken_out(coarse, 1, f"least(depth, {LEVELS})")
    folded = f"element_at(transform(array({nesting(bare)}), depth -> {fine}), 1)"
    arrows = f"replace({folded}, '=>', '{ARROW}')"
    return f"aggregate(array_repeat(0, {TYPE_PASSES}), {arrows}, (t, _) -> if(contains(t, '<'), regexp_replace(t, {literal(TYPE_LIST)}, ''), t))"


def functions(bare: str, flat: str) -> str:
    """Declared functions and variables that start as one, in the order in which the names come up."""
    found = f"concat({captures(bare, FUNCTIONS)}, {_pieces(captures(flat, VARIABLES), VARIABLE_FUNCTION)})"
    return f"array_intersect({captures(bare, INTRODUCED)}, {names(found)})"


def _pieces(blocks: str, pattern: str) -> str:
    """Split each block at commas and keep what the pattern captures of each piece."""
    split = f"flatten(transform({blocks}, b -> split(b, ',')))"
    return f"transform({split}, p -> regexp_extract(p, {literal(pattern)}, 1))"


def _when_found(text: str, pattern: str, name: str) -> str:
    return case({f"{text} rlike {literal(pattern)}": f"array('{name}')"}, NO_NAMES)


def es_exports(bare: str, flat: str) -> str:
    """Names of exported declarations and lists, ``default`` and ``*``."""
    parts = [
        _when_found(bare, EXPORT_DEFAULT, "default"),
        captures(bare, EXPORTED_DECLARATION),
        _pieces(captures(flat, EXPORTED_VARIABLES), VARIABLE_NAME),
        _pieces(captures(bare, EXPORTED_LIST), LISTED_NAME),
        captures(bare, EXPORTED_NAMESPACE),
        _when_found(bare, EXPORT_ALL, "*"),
    ]
    return f"concat({', '.join(parts)})"


def _object_keys(flat: str) -> str:
    """Keys of every object assigned as the module's exports; ``default`` for one without keys."""
    keys = f"filter({_pieces('array(body)', OBJECT_KEY)}, k -> k <> '')"
    return f"flatten(transform(transform({captures(flat, OBJECT_BODY)}, body -> {keys}), k -> if(size(k) > 0, k, array('default'))))"


def commonjs_exports(bare: str, flat: str) -> str:
    """Names given to ``module.exports``, ``exports.x`` and TypeScript's ``export =``.

    A value that is neither a name, a named definition nor an object counts as ``default``.
    """

    def count(pattern: str) -> str:
        return f"regexp_count({bare}, {literal(pattern)})"

    known = " + ".join(map(count, (ASSIGNED_NAME, ASSIGNED_DEFINITION, ASSIGNED_OBJECT)))
    parts = [
        captures(bare, ASSIGNED_NAME),
        captures(bare, ASSIGNED_DEFINITION),
        _object_keys(flat),
        case({f"{count(ASSIGNED)} > {known}": "array('default')"}, NO_NAMES),
        captures(bare, MEMBER),
    ]
    return f"concat({', '.join(parts)})"


def exports(bare: str, flat: str) -> str:
    # Most modules export in one way only, so each set of patterns runs where its word occurs.
    es = case({f"contains({bare}, 'export')": es_exports(bare, flat)}, NO_NAMES)
    assigned = f"contains({bare}, 'exports') or {bare} rlike {literal(ASSIGNED)}"
    return names(f"concat({es}, {case({assigned: commonjs_exports(bare, flat)}, NO_NAMES)})")


def fact_names(code: str, bare: str, flat: str, fact: str) -> str:
    if fact == "imports":
        return regex_matches(code, IMPORTS)
    if fact == "functions":
        return functions(bare, flat)
    if fact == "exports":
        return exports(bare, flat)
    return regex_matches(bare, {"classes": CLASSES, "interfaces": INTERFACES}[fact])
