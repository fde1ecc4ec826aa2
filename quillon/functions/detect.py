"""Languages of programs by the number of their signs. Native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.columns import stripped

# Signs of the two generations of Python, of Java, C++, C and Python, sought whatever the case.
PYTHON2_SIGNS = [
    r"print\s+[^(]", r"raw_input\s*\(", r"xrange\s*\(", r"\.iteritems\s*\(", r"\.iterkeys\s*\(", r"\.itervalues\s*\(", r"unicode\s*\(", r"basestring", r"long\s*\(", r"exec\s+[^(]",
    r"raise\s+\w+,", r"<>\s*", r"from\s+__future__\s+import",
]
PYTHON3_SIGNS = [
    r"print\s*\(", r"input\s*\(", r"range\s*\(", r"\.items\s*\(", r"\.keys\s*\(", r"\.values\s*\(", r"nonlocal\s+", r"async\s+def", r"await\s+", r"yield\s+from", r"@\w+\.setter", r"typing\.",
    r"f[\"']", r"pathlib\.",
]
LANGUAGE_SIGNS = {
    "java": [r"public\s+class\s+\w+", r"public\s+static\s+void\s+main", r"System\.out\.print", r"Scanner\s+\w+\s*=\s*new\s+Scanner", r"import\s+java\.", r"package\s+\w+"],
    "cpp": [
        *(rf"#include\s*<{h}>" for h in ("iostream", "vector", "string", "algorithm", "queue", "stack", "map", "set", "unordered_map", "unordered_set")),
        r"std::", r"using\s+namespace\s+std", r"cout\s*<<", r"cin\s*>>", r"endl", r"vector\s*<", r"string\s+\w+", r"class\s+\w+\s*\{", r"public\s*:", r"private\s*:", r"protected\s*:",
    ],
    "c": [*(rf"#include\s*<{h}\.h>" for h in ("stdio", "stdlib", "string", "math")), r"int\s+main\s*\(", r"printf\s*\(", r"scanf\s*\(", r"#define\s+\w+", r"malloc\s*\(", r"free\s*\("],
    "python": [r"def\s+\w+\s*\(", r"class\s+\w+\s*\(?.*\)?:", r"import\s+\w+", r"from\s+\w+\s+import", r"if\s+__name__\s*==\s*[\"']__main__[\"']", r"print\s*\(", r"input\s*\("],
}
# Signs that weigh more, and how much.
SURE_CPP, SURE_CPP_VOTES = [r"(?i)#include\s*<iostream>", r"std::", r"(?i)using\s+namespace\s+std"], 5
ANNOTATED = r":\s*\w+\s*=|def\s+\w+\([^)]*:\s*\w+"
INDENTED_SHARE, INDENTED_VOTES, SEMICOLON_SHARE = 0.2, 2, 0.3


def _one(found: Column, votes: int = 1) -> Column:
    return F.when(found, votes).otherwise(0)


def _votes(code: Column, signs: list[str]) -> Column:
    return reduce(lambda a, p: a + _one(code.rlike("(?i)" + p)), signs, F.lit(0))


def _count(code: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(code, F.lit(pattern), F.lit(0)))


def python_version(code: Column) -> Column:
    """python2, python3 or python: by the signs of either, two votes more for print as it is mostly written and for
    annotations, one for a future division and for u"" or b"" texts; python where the votes balance."""
    statements, calls = _count(code, r"print\s+[^(]"), _count(code, r"print\s*\(")
    two = _votes(code, PYTHON2_SIGNS) + _one(statements > calls, 2) + _one(code.contains("from __future__ import division")) + _one(code.rlike("(?i)[ub][\"']"))
    three = _votes(code, PYTHON3_SIGNS) + _one(calls > statements, 2) + _one(code.rlike(ANNOTATED), 2)
    return F.when(code.isNull(), None).when(two > three, "python2").when(three > two, "python3").otherwise("python")


def code_language(code: Column) -> Column:
    """java, cpp or c by the most votes, the first of these at a tie, else the version of Python.

    Besides the signs there are votes for C++ where it is certain, for Python where more than a fifth of the lines are
    indented, and for the other three where more than three tenths end in a semicolon and where there are braces.
    """
    lines = F.split(code, "\n")
    indented = F.size(F.filter(lines, lambda x: x.startswith("    ") | x.startswith("\t")))
    ended = F.size(F.filter(lines, lambda x: stripped(x).endswith(";")))
    braced = _one(ended > F.size(lines) * SEMICOLON_SHARE) + _one(code.contains("{") & code.contains("}"))
    votes = {k: _votes(code, v) + (F.lit(0) if k == "python" else braced) for k, v in LANGUAGE_SIGNS.items()}
    votes["cpp"] = votes["cpp"] + _one(reduce(lambda a, b: a | b, (code.rlike(p) for p in SURE_CPP)), SURE_CPP_VOTES)
    votes["python"] = votes["python"] + _one(indented > F.size(lines) * INDENTED_SHARE, INDENTED_VOTES)
    top = F.greatest(*votes.values())
    out = F.when(code.isNull(), None).when(top == 0, "python")
    for k in ("java", "cpp", "c"):
        out = out.when(votes[k] == top, k)
    return out.otherwise(python_version(code))
