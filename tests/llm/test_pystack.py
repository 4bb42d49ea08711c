"""The Python recogniser against the compiler."""

import sysconfig
import warnings
from pathlib import Path

import pytest

from spanwright.llm import pystack
from spanwright.llm.lexing import python_fault

warnings.simplefilter("ignore")

BAD = [
    "def f(:\n    pass\n", "print None\n", "exec 'x'\n", "class {{ name }}:\n    pass\n", "if x\n    y\n", "x = = 3\n", "def f():\npass\n", "def f():\n    a\n   b\n", "  x\n", "try:\n    x\ny\n", "else:\n    x\n", "SELECT a, COUNT(*) FROM t;\n", "* a list\n* of points\n", "while x \n",
    "for a in b:\n", "@d\nx = 1\n", "a b\n", "f(1 2)\n", "x = 012\n", "if a:\n\tb\n        c\n", "lambda x\n", "from a import\n", "import\n", "x = f'{a\n", "return x y\n", "not_a_def('a', 'b'c)\n", "def f():\n    x = (1,\n", "a = }\n", "raise IOError, 'gone'\n", "def g():\n    pass\n      yield s\n", "a.1\n", "x = not\n",
]
GOOD = [
    "", "\n\n# only a comment", "x, = y\nfor a, in b: pass\n", "@d\n@e.f(1)\nasync def f(a, /, b: int = 2, *, c=lambda *a, k=1, **kw: (a, k), **d) -> 'x':\n    async with a as b, c: await d\n    return [i async for i in b if not x or y]\n",
    "match x:\n    case {'a': [1, *_], **r} if r: pass\n    case P(x=0) | None as q:\n        pass\nmatch = 1\nmatch(x)\ncase, type = 1, 2\ntype X[T: int, *Ts, **P] = list[T]\ntype Y[T = str] = T\n", "try: x\nexcept* (A, B) as e: pass\nelse: y\nfinally:\n    z\n",
    "f'{a!r:>{w}} {b[\"k\"]} {{}} {f\"{c}\"}'\n", "x = a if b else c if d else e; y: int; z[1:2, ::3, ..., *q] = w = v\n", "from . import a as b\nfrom ..c.d import (e, f as g,)\nfrom . import *\n", "with (open(a) as b, c as d,):\n    pass\n", "if (m := f()) > 3: pass\nprint(*a, sep='', **k)\n{**a, 'b': 1}\n[*a, *b]\n",
    "def f():\n\tif x:\n\t\treturn\n\telse:\n\t\tyield\n", "if a: b; c\nelif d: e\nelse: f\n", "x = (\n  1,\n\n  # note\n  2\n)\n", "a = 1if b else 2\nassert x, 'y'\ndel a, b[0]\nglobal g\n", "class A(B, metaclass=M): x = 1\nclass C[T](D): ...\n", "x = a \\\n  + b\n", "while True:\n    break\nelse:\n    pass\n",
]


def compiles(text):
    try:
        compile(text, "f", "exec", dont_inherit=True)
    except SyntaxError as e:
        return "outside" in str(e) or "prior to global" in str(e)
    return True


@pytest.mark.parametrize("text", BAD)
def test_faults(text):
    assert not compiles(text) and (python_fault(text) or pystack.fault(text))


@pytest.mark.parametrize("text", GOOD)
def test_passes(text):
    assert compiles(text) and pystack.fault(text) is None


def test_standard_library():
    files = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[:80]
    assert len(files) > 40 and not [f.name for f in files if pystack.fault(f.read_text("utf-8"))]


def test_every_truncation_is_judged_as_the_compiler_does():
    text = "import os\n\n\nclass A(B):\n    def f(self, a, b=(1, 2)):\n        '''Doc.'''\n        for i in range(3):\n            if a and i:\n                x = {'k': [a, f\"{b!r}\"], 'l': lambda: 0}\n        try:\n            return x\n        except E as e:\n            raise F(e) from None\n"
    for n in range(len(text)):
        part = text[:n]
        assert bool(python_fault(part) or pystack.fault(part)) != compiles(part), part[-40:]
