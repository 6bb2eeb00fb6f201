"""Grades solutions that can do nothing but reckon, many in one process.

This file is a program of its own as well: `code.Lane` runs its source in a process apart, so it imports the standard library only.
A solution is taken here only if its compiled code, and that of its tests, holds nothing but the operations, builtins and methods named
below. Such code has no import, no class, no handler of exceptions and no way to a frame, a file, a module or another's objects, so
whether a process of its own or a common one runs it makes no difference. Everything else is left open, for `code.Sandbox` to grade.
"""

import ast
import builtins
import gc
import inspect
import json
import opcode
import os
import sys
import types

#: Operations by name; on a Python that names its operations otherwise nothing passes, and all is left open.
OPS = """CACHE RESUME NOP POP_TOP PUSH_NULL COPY SWAP EXTENDED_ARG LOAD_CONST RETURN_CONST RETURN_VALUE LOAD_FAST LOAD_FAST_LOAD_FAST LOAD_FAST_CHECK LOAD_FAST_AND_CLEAR
STORE_FAST STORE_FAST_STORE_FAST STORE_FAST_LOAD_FAST DELETE_FAST LOAD_GLOBAL STORE_GLOBAL LOAD_NAME STORE_NAME LOAD_DEREF STORE_DEREF MAKE_CELL COPY_FREE_VARS
BINARY_OP UNARY_NEGATIVE UNARY_NOT UNARY_INVERT COMPARE_OP CONTAINS_OP IS_OP TO_BOOL BINARY_SUBSCR STORE_SUBSCR DELETE_SUBSCR BINARY_SLICE STORE_SLICE BUILD_SLICE
BUILD_LIST BUILD_TUPLE BUILD_SET BUILD_MAP BUILD_CONST_KEY_MAP BUILD_STRING LIST_APPEND LIST_EXTEND SET_ADD SET_UPDATE MAP_ADD DICT_UPDATE DICT_MERGE UNPACK_SEQUENCE UNPACK_EX
CONVERT_VALUE FORMAT_SIMPLE FORMAT_WITH_SPEC JUMP_FORWARD JUMP_BACKWARD POP_JUMP_IF_TRUE POP_JUMP_IF_FALSE POP_JUMP_IF_NONE POP_JUMP_IF_NOT_NONE GET_ITER FOR_ITER END_FOR
CALL CALL_KW CALL_FUNCTION_EX MAKE_FUNCTION SET_FUNCTION_ATTRIBUTE LOAD_ATTR RAISE_VARARGS RERAISE LOAD_ASSERTION_ERROR CALL_INTRINSIC_1 RETURN_GENERATOR YIELD_VALUE""".split()
BUILTINS = frozenset(
    """None True False NotImplemented abs all any bin bool chr dict divmod enumerate filter float frozenset hex int isinstance issubclass iter len list map max min next oct ord pow print range
    repr reversed round set slice sorted str sum tuple zip ArithmeticError AssertionError AttributeError Exception IndexError KeyError LookupError NotImplementedError OverflowError RuntimeError StopIteration
    TypeError ValueError ZeroDivisionError""".split()
)
METHODS = frozenset(
    """append extend insert remove pop clear index count sort reverse copy get items keys values update setdefault popitem add discard union intersection difference symmetric_difference issubset issuperset
    isdisjoint capitalize casefold center endswith expandtabs find isalnum isalpha isdecimal isdigit islower isnumeric isspace istitle isupper join ljust lower lstrip partition removeprefix removesuffix replace
    rfind rindex rjust rpartition rsplit rstrip split splitlines startswith strip swapcase title upper zfill bit_length is_integer""".split()
)
_OPMAP = opcode.opmap
_KNOWN = frozenset(_OPMAP[x] for x in OPS if x in _OPMAP)
_ATTR, _WIDE, _INTRINSIC = (_OPMAP.get(x, -1) for x in ("LOAD_ATTR", "EXTENDED_ARG", "CALL_INTRINSIC_1"))
#: The end of a generator, unary plus, and a list made a tuple.
_INTRINSICS = frozenset(i for i, x in enumerate(getattr(opcode, "_intrinsic_1_descs", [])) if x in ("INTRINSIC_STOPITERATION_ERROR", "INTRINSIC_UNARY_POSITIVE", "INTRINSIC_LIST_TO_TUPLE"))
_ASYNC = inspect.CO_COROUTINE | inspect.CO_ITERABLE_COROUTINE | inspect.CO_ASYNC_GENERATOR
_BARRED = frozenset(dir(builtins)) - BUILTINS
#: What a solution meets where memory or the stack ends depends on the process it is in.
LIMITS = (MemoryError, RecursionError)
#: Bytes of memory and depth of the stack, both less than a process of its own has: what needs more is left open.
MEMORY, DEPTH = 1 << 28, 900


def harmless(code: types.CodeType) -> bool:
    """Whether code, with all functions in it, can only reckon."""
    text = code.co_code
    ops = text[::2]
    if not _KNOWN.issuperset(ops) or code.co_flags & _ASYNC:
        return False
    for n in code.co_names:
        if n in _BARRED or n.startswith("__"):
            return False
    for op in (_ATTR, _INTRINSIC):
        at = ops.find(op)
        while at >= 0:
            arg = text[2 * at + 1]
            if at and ops[at - 1] == _WIDE:
                if at > 1 and ops[at - 2] == _WIDE:
                    return False
                arg |= text[2 * at - 1] << 8
            if code.co_names[arg >> 1] not in METHODS if op == _ATTR else arg not in _INTRINSICS:
                return False
            at = ops.find(op, at + 1)
    return all(harmless(c) for c in code.co_consts if isinstance(c, types.CodeType))


def cases(source: str) -> list[tuple[types.CodeType, int]] | None:
    """A suite's statements, each with the number of its asserts; None for one that isn't taken here."""
    try:
        tree = ast.parse(source)
        # A name is written as it is read only in ASCII.
        if ("test_" in source or not source.isascii()) and any(isinstance(n, ast.FunctionDef) and n.name.startswith("test_") for n in ast.walk(tree)):
            return None
        # No assert stands within another.
        found = [(compile(ast.Module([n], []), "test_solution.py", "exec", dont_inherit=True), 1 if isinstance(n, ast.Assert) else sum(isinstance(x, ast.Assert) for x in ast.walk(n))) for n in tree.body]
    except (SyntaxError, ValueError, *LIMITS):
        return None
    return found if all(harmless(c) for c, _ in found) else None


def grade(source: str, suites: list[list[tuple[types.CodeType, int]] | None]) -> list | None:
    """[error class, passed and total cases of each suite], None where it is left open. The solution is loaded anew for each suite that isn't empty."""
    try:
        code = compile(source, "solution.py", "exec", dont_inherit=True)
    except (SyntaxError, ValueError, *LIMITS):
        return None
    if not source.strip() or not harmless(code):
        return None
    state, counts = "none", []
    for suite in suites:
        total, passed = sum(n for _, n in suite or ()), 0
        if suite is not None:
            solution = types.ModuleType("solution")
            solution.__file__ = "solution.py"
            scope, error = vars(solution), tried(code, vars(solution))
            if isinstance(error, LIMITS):
                return None
            if error is not None:
                state = "runtime_error"
            else:
                scope = dict(scope)
                for case, n in suite:
                    error = tried(case, scope)
                    if isinstance(error, LIMITS):
                        return None
                    passed += n * (error is None)
                scope.clear()
            vars(solution).clear()
        counts += [passed, total]
    return [state, *counts]


def tried(code: types.CodeType, scope: dict) -> BaseException | None:
    try:
        exec(code, scope)  # noqa: S102
    except BaseException as e:
        return e.with_traceback(None)
    return None


def serve() -> None:
    """A line when it is ready; then lines of [[visible suite, hidden suite, [solution, ...]], ...] answered by a line for each solution."""
    import resource

    resource.setrlimit(resource.RLIMIT_AS, (MEMORY, MEMORY))
    answers, null = os.dup(1), os.open(os.devnull, os.O_RDWR)
    for fd in (1, 2):
        os.dup2(null, fd)
    gc.freeze()
    sys.setrecursionlimit(DEPTH)
    os.write(answers, b"\n")
    for line in sys.stdin:
        for visible, hidden, sources in json.loads(line):
            suites = [cases(x) if x.strip() else None for x in (visible, hidden)]
            taken = all(s is not None or not x.strip() for s, x in zip(suites, (visible, hidden)))
            for source in sources:
                os.write(answers, (json.dumps(grade(source, suites) if taken else None) + "\n").encode())


if __name__ == "__main__":
    serve()
