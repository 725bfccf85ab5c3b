"""JavaScript whose texts hold code and whose code holds texts: template literals and JSX.

What a quote, a slash or a brace means there depends on where it stands, so the text is cut into tokens and these are
read one by one with a stack of modes, one letter each:

``c`` code, ``b`` braces in code, ``x`` code inside a template, ``t`` template text, ``q`` and ``d`` quoted strings,
``l`` and ``m`` comments, ``r`` and ``s`` regular expressions and their character classes, ``j`` a JSX tag,
``k`` JSX text, ``e`` a closing JSX tag.

What comes out is code without comments, regular expressions, template texts and JSX texts: a template or an element
starts with an empty string, and the code of a template stands in round brackets. Strings stay as they are.
"""

from __future__ import annotations

from .sqltext import case, literal

#: Tokens folded at a time; what they come to is one string, so that long texts are not copied for every token.
CHUNK = 128
# An opening tag, but not the type parameters of an arrow function.
_OPEN = r"<(?=[\w$>])(?![\w$]++\s*+(?:,|extends\s))"
TOKENS = (
    rf"(?s)\\.|\*/|//|/\*|/>|</|{_OPEN}|=>|\$\{{"
    rf"|(?:[^\\/*<>=$'\"`{{}}\[\]\n]|=(?!>)|\$(?!\{{)|\*(?!/)|(?!{_OPEN})<(?!/))++|."
)
# Where an expression starts: a slash is a regular expression there, and a tag is JSX.
_EXPECTED = r"^$|[=(,:\[!&|?{};>+*%~^-]$|(?:^|[^\w$.])(?:return|typeof|case|default|yield|await)$"
#: Texts that the plain patterns cannot read.
NEEDED = r"\$\{|</|/>"


def _to(stack: str, emitted: str) -> str:
    """The state after a token: the modes, the end of the last code, and the text so far."""
    last = "s.last" if emitted in ("''", "' '", "'\\n'") else f"if(trim({emitted}) = '', s.last, right(rtrim({emitted}), 8))"
    return f"struct({stack} as stack, {last} as last, concat(s.out, {emitted}) as out)"


_POP = "left(s.stack, length(s.stack) - 1)"


def _push(mode: str) -> str:
    return f"concat(s.stack, '{mode}')"


def _swap(mode: str) -> str:
    return f"concat({_POP}, '{mode}')"


def _step(jsx: str) -> str:
    top, line = "right(s.stack, 1)", "t = '\\n'"
    kept = f"if({line}, t, '')"
    expected = f"s.last rlike {literal(_EXPECTED)}"
    stay = _to("s.stack", "t")
    in_code = {
        "t = '//'": _to(_push("l"), "''"),
        "t = '/*'": _to(_push("m"), "' '"),
        "t = '''' or t = '\"'": _to("concat(s.stack, if(t = '\"', 'd', 'q'))", "t"),
        "t = '`'": _to(_push("t"), "'\"\"'"),
        "t = '{'": _to(_push("b"), "t"),
        f"t = '}}' and {top} = 'x'": _to(_POP, "')'"),
        f"t = '}}' and {top} = 'b'": _to(_POP, "t"),
        f"t in ('/', '/>') and {expected}": _to(_push("r"), "' '"),
        f"t = '<' and {jsx} and {expected}": _to(_push("j"), "'\"\"'"),
    }
    in_template = {"t = '`'": _to(_POP, "''"), "t = '${'": _to(_push("x"), "'('")}
    # A string ends with its line, unless it is an attribute of a tag.
    in_string = {f"t = if({top} = 'd', '\"', '''') or ({line} and substr(s.stack, -2, 1) <> 'j')": _to(_POP, "t")}
    in_tag = {
        "t = '''' or t = '\"'": _to("concat(s.stack, if(t = '\"', 'd', 'q'))", "t"),
        "t = '{'": _to(_push("b"), "t"),
        "t = '/>'": _to(_POP, "''"),
        "t = '>'": _to(_swap("k"), "''"),
    }
    in_jsx_text = {"t = '{'": _to(_push("b"), "t"), "t = '<'": _to(_push("j"), "''"), "t = '</'": _to(_swap("e"), "''")}
    quiet = _to("s.stack", kept)
    return case(
        {
            f"{top} in ('c', 'b', 'x')": case(in_code, stay),
            f"{top} in ('q', 'd')": case(in_string, stay),
            f"{top} = 't'": case(in_template, quiet),
            f"{top} = 'l'": case({line: _to(_POP, "t")}, _to("s.stack", "''")),
            f"{top} = 'm'": case({"t = '*/'": _to(_POP, "''")}, quiet),
            f"{top} = 'r'": case({"t in ('/', '//', '/*', '*/', '/>', '</')": _to(_POP, "''"), "t = '['": _to(_push("s"), "''"), line: _to(_POP, "t")}, quiet),
            f"{top} = 's'": case({f"t = ']' or {line}": _to(_POP, kept)}, quiet),
            f"{top} = 'j'": case(in_tag, quiet),
            f"{top} = 'k'": case(in_jsx_text, quiet),
        },
        case({"t = '>'": _to(_POP, "''")}, quiet),
    )


def _bound(value: str, name: str, expression: str) -> str:
    """``expression`` with ``value`` worked out once under a name."""
    return f"element_at(transform(array({value}), {name} -> {expression}), 1)"


def plain_code(content: str, jsx: str) -> str:
    """The text as code that the plain patterns can read; ``jsx`` says whether the file may hold JSX."""
    piece = f"aggregate(slice(ts, i * {CHUNK} + 1, {CHUNK}), struct(o.stack as stack, o.last as last, '' as out), (s, t) -> {_step(jsx)})"
    outer = _bound(piece, "r", "struct(r.stack as stack, r.last as last, concat(o.parts, array(r.out)) as parts)")
    start = "struct('c' as stack, '' as last, cast(array() as array<string>) as parts)"
    folded = f"aggregate(sequence(0, cast(size(ts) / {CHUNK} as int)), {start}, (o, i) -> {outer}, o -> array_join(o.parts, ''))"
    tokens = f"regexp_extract_all({content}, {literal(TOKENS)}, 0)"
    return f"if({content} rlike {literal(NEEDED)}, {_bound(tokens, 'ts', folded)}, {content})"
