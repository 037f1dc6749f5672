"""Keyword rules that turn a query text into weights and include flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from cairn.functions.text import planner_tokens, search_tokens

# The keyword sets of the plan rules.
ARCHITECTURE = set("architecture overview repo repository subsystem subsystems map".split())
TEST = set("test tests testing spec fixture fixtures mock mocks coverage".split())
EDIT = set("edit change modify fix debug refactor implement update remove add".split())
TRACE = set("dependency dependencies depends dependent downstream upstream breaks impact blast trace flow".split())
READ = set("read explain understand next".split())
PLACES = set("where defined definition usage uses".split())
SYMBOL = set("symbol defined definition usage uses where".split())
BEHAVIOUR = set("behavior logic responsibility handles how".split())
# The keyword sets of the scorer.
EDIT_LIKE = set("edit change debug fix refactor modify add remove implement update".split())
EDIT_WORDS = set("edit change debug fix refactor modify add".split())
BEHAVIOUR_LIKE = set("behavior flow logic responsibility resolve resolution".split())
ENTRYPOINT = set("entrypoint exports export reexport public surface api".split())
FOLDER = set("folder module area subsystem".split())
REPO = set("repo repository architecture overview subsystem subsystems".split())
TEST_QUERY = set("test tests testing pytest unit integration spec fixture mock assert coverage".split())
WANTS_TESTS = set("test tests testing fixture fixtures spec coverage".split())
# Mode -> lexical, semantic, symbol, card, graph weight, repo card, folder cards, graph neighbours, tests.
MODES = {
    "architecture_overview": (0.9, 1.0, 0.4, 1.45, 0.8, True, True, False, "penalize"),
    "test_lookup": (1.2, 0.8, 0.9, 0.9, 0.7, False, False, True, "prefer"),
    "edit_target": (1.1, 0.9, 1.0, 1.2, 1.0, False, False, True, "penalize"),
    "trace_dependency": (1.0, 0.95, 0.9, 1.05, 1.4, False, True, True, "neutral"),
    "read_next": (0.95, 1.05, 0.8, 1.25, 1.1, False, True, True, "neutral"),
    "find_symbol": (1.35, 0.7, 1.5, 0.8, 0.8, False, False, False, "neutral"),
    "find_behavior": (0.9, 1.2, 0.7, 1.25, 0.8, False, True, False, "penalize"),
    "general": (1.0, 1.0, 1.0, 1.0, 0.8, False, False, False, "penalize"),
}
# Query texts of the tasks and of the warm-up.
TASKS = {
    "find-symbol": "where is {q} defined symbol definition usage",
    "find-behavior": "how does {q} behavior logic responsibility work",
    "edit-target": "where should I edit change fix implement {q}",
    "trace-dependency": "trace dependency impact blast radius downstream upstream {q}",
    "architecture": "repository architecture overview subsystem {q}",
    "tests-for": "tests fixtures spec coverage for {q}",
    "read-next": "read next before editing understand implementation {q}",
}
PREWARM_QUERIES = [
    "repository architecture",
    "where are symbols defined",
    "where should I edit behavior",
    "dependency impact blast radius",
    "tests fixtures integration",
    "read next implementation owner",
]


@dataclass(frozen=True)
class QueryPlan:
    query: str
    mode: str
    lexical: float
    semantic: float
    symbol: float
    card: float
    graph: float
    repo_card: bool
    folder_cards: bool
    graph_neighbours: bool
    tests: str
    tokens: list[str] = field(default_factory=list)

    def any(self, words: set[str]) -> bool:
        return any(t in words for t in self.tokens)

    @property
    def test_query(self) -> bool:
        return self.tests == "prefer" or self.any(TEST_QUERY)

    @property
    def owner_query(self) -> bool:
        return (self.any(EDIT_LIKE) or self.any(BEHAVIOUR_LIKE)) and not self.any(ENTRYPOINT)


def plan_query(query: str) -> QueryPlan:
    """The plan of a query: the first rule that matches its tokens decides."""
    tokens = planner_tokens(query)
    words = set(tokens)
    identifier = any("_" in t or "::" in t or any(c.isupper() for c in t) for t in tokens)
    read = words & READ or ("before" in words and not words & PLACES)
    rules = [
        ("architecture_overview", words & ARCHITECTURE),
        ("test_lookup", words & TEST),
        ("edit_target", words & EDIT),
        ("trace_dependency", words & TRACE),
        ("read_next", read),
        ("find_symbol", identifier or words & SYMBOL),
        ("find_behavior", words & BEHAVIOUR),
        ("general", True),
    ]
    mode = next(m for m, hit in rules if hit)
    values = list(MODES[mode])
    if mode == "find_symbol":
        values[7] = bool(words & {"usage", "uses"})
    return QueryPlan(query, mode, *values, tokens=search_tokens(query))


def task_query(task: str, query: str) -> str:
    return TASKS[task].format(q=query)


def candidate_limit(limit: int) -> int:
    return max(96, 24 * max(limit, 8))


def wants_tests(query: str) -> bool:
    import re

    return any(t.lower() in WANTS_TESTS for t in re.split(r"[^\w]+", query))
