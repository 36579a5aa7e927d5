"""Prompt refinement as batch operators: every target advances together.

A search is a state per target and two column expressions: the prompts that the
state proposes in a round, and the state that follows from them and their
scores. With the default scorer, hashed words against the target's vector, both
are JVM expressions: a target's row holds its state and its vector, and all
rounds are one projection, without a shuffle, a window or Python. With a text or
embedding provider, a round sends the proposed prompts, one row each, through
the providers, and is written before the next one begins.

Randomness is a uniform drawn from md5(seed | target | iteration | slot |
position | purpose), never ``rand()``: a retried task or a different number
of partitions gives the same table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.functions import vector as VX
from promptlens.functions.columns import let
from promptlens.functions.frames import written
from promptlens.operators.embed import EmbeddingProvider, hash_score
from promptlens.operators.generate import best_per_target, score_prompts
from promptlens.operators.respond import TextProvider

# Fixed values of the mutation operators, verbatim and in their natural order.
SYNONYMS = {
    "create": ["generate", "make", "build", "construct"],
    "explain": ["describe", "clarify", "elaborate", "detail"],
    "write": ["compose", "draft", "author", "pen"],
    "analyze": ["examine", "study", "evaluate", "assess"],
    "compare": ["contrast", "evaluate", "examine", "review"],
}
MODIFIERS = ["carefully", "thoroughly", "clearly", "precisely", "effectively"]

# Defaults of the refinement configuration.
MAX_ITERATIONS = 10
POPULATION = 5
MUTATION_RATE = 0.1
CROSSOVER_RATE = 0.7
TEMPERATURE = 1.0
COOLING = 0.95
BEAM_WIDTH = 3
MAX_NO_IMPROVEMENT = 5
SEED = 42


@dataclass(frozen=True)
class RefineConfig:
    """How a prompt is refined; every field reaches the strategy."""
    strategy: str = "simple"
    iterations: int = MAX_ITERATIONS
    population: int = POPULATION
    mutation_rate: float = MUTATION_RATE
    crossover_rate: float = CROSSOVER_RATE
    temperature: float = TEMPERATURE
    cooling: float = COOLING
    beam_width: int = BEAM_WIDTH
    patience: int = MAX_NO_IMPROVEMENT
    seed: int = SEED

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}; expected one of {STRATEGIES}")
        for name in ("population", "beam_width", "patience"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("mutation_rate", "crossover_rate"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in 0..1")
        if self.iterations < 0 or self.temperature <= 0 or not 0 < self.cooling <= 1:
            raise ValueError("iterations >= 0, temperature > 0 and cooling in (0, 1] are asked for")


STRATEGIES = ("simple", "hill_climbing", "evolutionary", "beam_search", "simulated_annealing")


def uniform(*parts) -> Column:
    """u in [0, 1) from md5 of the '|'-joined parts (columns or literals)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    h = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _below(digits: Column, share: float) -> Column:
    """Whether the uniform that these hex digits state is below ``share``: they
    compare as their number does, so they need not be turned into one."""
    bound = math.ceil(share * 2 ** 32)  # the product is exact
    return digits < F.lit(f"{bound:08x}") if 0 < bound < 2 ** 32 else F.lit(bound > 0)


def _syn_map() -> Column:
    kv = []
    for k, vs in SYNONYMS.items():
        kv += [F.lit(k), F.array(*[F.lit(v) for v in vs])]
    return F.create_map(*kv)


def _mods() -> Column:
    return F.array(*[F.lit(m) for m in MODIFIERS])


# ----------------------------------------------------------------- single edits
def _spliced(w: Column, i: Column, n: int, *new: Column) -> Column:
    """``w`` with ``new`` in place of the ``n`` words from index ``i``."""
    put = [F.array(*new)] if new else []
    return F.concat(F.slice(w, F.lit(1), i), *put, F.slice(w, i + (n + 1), F.size(w)))


def edit_synonym(w: Column, i: Column, r: Column) -> Column:
    syn = F.element_at(_syn_map(), F.lower(F.get(w, i)))
    pick = F.get(syn, F.floor(r * 4).cast("int"))
    return F.when((i < F.size(w)) & syn.isNotNull(), _spliced(w, i, 1, pick)).otherwise(w)


def edit_insert(w: Column, rpos: Column, rword: Column) -> Column:
    pos = F.floor(rpos * (F.size(w) + 1)).cast("int")
    word = F.get(_mods(), F.floor(rword * len(MODIFIERS)).cast("int"))
    return F.array_insert(w, pos + 1, word)


def edit_delete(w: Column, i: Column) -> Column:
    return F.when((F.size(w) > 3) & (i < F.size(w)), _spliced(w, i, 1)).otherwise(w)


def edit_swap(w: Column, i: Column) -> Column:
    return F.when(i < F.size(w) - 1, _spliced(w, i, 2, F.get(w, i + 1), F.get(w, i))).otherwise(w)


def edit_restructure(w: Column) -> Column:
    n = F.size(w)
    mid = F.floor(n / 2).cast("int")
    return F.when(n > 6, F.concat(F.slice(w, mid + 1, n - mid), F.slice(w, F.lit(1), mid))).otherwise(w)


def mutate(prompt: Column, rate: float, *key) -> Column:
    """Each original word position i, with probability ``rate``, applies one
    of the five edits (chosen uniformly) to the current word list at index i;
    an edit whose index no longer exists is skipped."""
    def draw(head, i, tag):
        return F.concat(head, i.cast("string"), F.lit(f"|{tag}"))

    def hits(head, n):
        """The positions that are hit, each with the digits that choose its edit."""
        places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: _below(F.md5(draw(head, i, "m")), rate))
        return F.transform(places, lambda i: F.struct(i.alias("i"), F.md5(draw(head, i, "t")).alias("t")))

    def step(head, acc, x):
        i, r, r2 = x["i"], uniform(draw(head, x["i"], "r")), uniform(draw(head, x["i"], "r2"))
        return (F.when(_below(x["t"], 1 / 5), edit_synonym(acc, i, r))
                .when(_below(x["t"], 2 / 5), edit_insert(acc, r, r2))
                .when(_below(x["t"], 3 / 5), edit_delete(acc, i))
                .when(_below(x["t"], 4 / 5), edit_swap(acc, i))
                .otherwise(edit_restructure(acc)))

    def edited(w0):
        # what all draws of this prompt begin with
        head = F.concat(F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in key]), F.lit("|"))
        return F.when(F.size(w0) == 0, prompt).otherwise(let(head, lambda head: F.array_join(
            F.aggregate(hits(head, F.size(w0)), w0, lambda acc, x: step(head, acc, x)), " ")))

    return let(T.words(prompt), edited)


def crossover(p1: Column, p2: Column, *key) -> tuple[Column, Column]:
    """Single point per parent in 1..len-1; an empty or one-word parent
    leaves both unchanged."""
    a, b = T.words(p1), T.words(p2)
    ok = (F.size(a) >= 2) & (F.size(b) >= 2)
    c1 = (F.floor(uniform(*key, "c1") * (F.size(a) - 1)) + 1).cast("int")
    c2 = (F.floor(uniform(*key, "c2") * (F.size(b) - 1)) + 1).cast("int")
    o1 = F.concat(F.slice(a, F.lit(1), c1), F.slice(b, c2 + 1, F.size(b)))
    o2 = F.concat(F.slice(b, F.lit(1), c2), F.slice(a, c1 + 1, F.size(a)))
    return (F.when(ok, F.array_join(o1, " ")).otherwise(p1),
            F.when(ok, F.array_join(o2, " ")).otherwise(p2))


# ----------------------------------------------------------------- searches
@dataclass(frozen=True)
class Search:
    """``propose(state, target, it)``: the prompts to score; ``accept(state,
    prompts, scores, target, it)``: the state afterwards; ``state``: its type."""
    state: str
    propose: Callable[[Column, Column, Column], Column]
    accept: Callable[[Column, Column, Column, Column, Column], Column]


def _gain(new: Column, old: Column) -> Column:
    return F.round(new, 9) > F.round(old, 9)  # ties within 1e-9: no gain


def _ranked(entries: Column) -> Column:
    """``entries`` (struct with score and place) best score first, then place."""
    return F.sort_array(F.transform(entries, lambda x: F.struct(
        (-F.round(x["score"], 9)).alias("key"), x["place"].alias("place"), x["prompt"].alias("prompt"), x["score"].alias("score"))))


def _entry(place: Column, prompt: Column, score: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), prompt.alias("prompt"), score.alias("score"))


_POOL = "array<struct<place: int, prompt: string, score: double>>"


def hill_search(c: RefineConfig) -> Search:
    """Accept a mutation only if strictly better; stop a target after
    ``patience`` misses in a row."""
    def propose(s, target, it):
        return F.when(s["misses"] < c.patience, F.array(mutate(s["prompt"], c.mutation_rate, c.seed, target, it, 0))).otherwise(
            F.array().cast("array<string>"))

    def accept(s, prompts, scores, target, it):
        better = _gain(F.get(scores, F.lit(0)), s["score"])
        moved = F.struct(F.when(better, F.get(prompts, F.lit(0))).otherwise(s["prompt"]).alias("prompt"),
                         F.when(better, F.get(scores, F.lit(0))).otherwise(s["score"]).alias("score"),
                         F.when(better, F.lit(0)).otherwise(s["misses"] + 1).alias("misses"), (s["rounds"] + 1).alias("rounds"))
        return F.when(F.size(prompts) > 0, moved).otherwise(s)

    return Search("struct<prompt: string, score: double, misses: int, rounds: int>", propose, accept)


def anneal_search(c: RefineConfig) -> Search:
    """Accept if better or u < exp(delta / T); T falls by ``cooling`` a round.
    The best is kept apart."""
    def propose(s, target, it):
        return F.array(mutate(s["prompt"], c.mutation_rate, c.seed, target, it, 1))

    def accept(s, prompts, scores, target, it):
        heat = F.lit(c.temperature) * F.pow(F.lit(c.cooling), it)
        taken = _gain(F.get(scores, F.lit(0)), s["score"]) | (uniform(c.seed, target, it, "accept") < F.exp((F.get(scores, F.lit(0)) - s["score"]) / heat))
        best = taken & _gain(F.get(scores, F.lit(0)), s["best_score"])
        pick = lambda hit, new, name: F.when(hit, new).otherwise(s[name]).alias(name)
        return F.struct(pick(taken, F.get(prompts, F.lit(0)), "prompt"), pick(taken, F.get(scores, F.lit(0)), "score"),
                        pick(best, F.get(prompts, F.lit(0)), "best_prompt"), pick(best, F.get(scores, F.lit(0)), "best_score"))

    return Search("struct<prompt: string, score: double, best_prompt: string, best_score: double>", propose, accept)


def beam_search_of(c: RefineConfig) -> Search:
    """Two mutations per beam member; the best ``beam_width`` of old and new
    stay (ties: lower place first). The best score of each round is kept."""
    def propose(s, target, it):
        return F.flatten(F.transform(s["beam"], lambda b: F.transform(
            F.array(F.lit(1), F.lit(2)), lambda m: mutate(b["prompt"], c.mutation_rate, c.seed, target, it, b["place"], m))))

    def accept(s, prompts, scores, target, it):
        old = F.transform(s["beam"], lambda b: _entry(b["place"] * 10, b["prompt"], b["score"]))
        parent = lambda i: F.get(s["beam"], F.floor(i / 2).cast("int"))["place"]
        new = F.transform(prompts, lambda p, i: _entry(parent(i) * 10 + i % 2 + 1, p, F.get(scores, i)))
        kept = F.transform(F.slice(_ranked(F.concat(old, new)), 1, c.beam_width), lambda x, i: _entry(i + 1, x["prompt"], x["score"]))
        return let(kept, lambda beam: F.struct(beam.alias("beam"), F.concat(s["history"], F.array(F.get(beam, F.lit(0))["score"])).alias("history")))

    return Search(f"struct<beam: {_POOL}, history: array<double>>", propose, accept)


def evolve_search(c: RefineConfig) -> Search:
    """Tournament of 3, crossover and mutation by their rates; the population
    is replaced each round, grows to its size in the first, and the best ever
    is kept apart."""
    def child(s, target, it, k):
        key = (c.seed, target, it, k)
        drawn = F.array_sort(F.transform(s["pool"], lambda x: F.struct(
            uniform(*key, x["place"], "tour").alias("u"), x["place"].alias("place"), x["prompt"].alias("prompt"), x["score"].alias("score"))))
        first = F.get(_ranked(F.slice(drawn, 1, min(3, c.population))), F.lit(0))["prompt"]
        second = F.get(s["pool"], F.floor(uniform(*key, "p2") * F.size(s["pool"])).cast("int"))["prompt"]

        def born(a, b):
            one, two = crossover(a, b, *key)
            mixed = F.when(uniform(*key, "cx") < c.crossover_rate, F.when(uniform(*key, "pick") < 0.5, one).otherwise(two)).otherwise(a)
            return let(mixed, lambda m: F.when(uniform(*key, "mut") < c.mutation_rate, mutate(m, c.mutation_rate, *key)).otherwise(m))

        return let(first, lambda a: let(second, lambda b: born(a, b)))

    def propose(s, target, it):
        return F.transform(F.sequence(F.lit(1), F.lit(c.population)), lambda k: child(s, target, it, k))

    def accept(s, prompts, scores, target, it):
        pool = F.transform(prompts, lambda p, i: _entry(i + 1, p, F.get(scores, i)))

        def best(pool, top):
            better = _gain(top["score"], s["best_score"])
            return F.struct(pool.alias("pool"), F.when(better, top["prompt"]).otherwise(s["best_prompt"]).alias("best_prompt"),
                            F.when(better, top["score"]).otherwise(s["best_score"]).alias("best_score"))

        return let(pool, lambda pool: let(F.get(_ranked(pool), F.lit(0)), lambda top: best(pool, top)))

    return Search(f"struct<pool: {_POOL}, best_prompt: string, best_score: double>", propose, accept)


def run_search(search: Search, start: DataFrame, tvecs: DataFrame, iterations: int, provider: EmbeddingProvider | None = None,
               text_provider: TextProvider | None = None) -> DataFrame:
    """``start`` (target_id, state) -> (target_id, state) after all rounds."""
    target = F.col("target_id")
    start = start.select("target_id", F.col("state").cast(search.state).alias("state"))
    if iterations < 1:
        return start
    if provider is None and text_provider is None:
        def step(s, it):
            return let(search.propose(s, target, it), lambda prompts: let(
                F.transform(prompts, lambda p: hash_score(p, F.col("_tv"))),
                lambda scores: search.accept(s, prompts, scores, target, it).cast(search.state)))

        rows = start.join(tvecs.select("target_id", VX.normalize("target_vec").alias("_tv")), "target_id", "left")
        return rows.select("target_id", F.aggregate(F.sequence(F.lit(0), F.lit(iterations - 1)), "state", step).alias("state"))
    state = start
    for it in range(iterations):
        asked = written(state.select("target_id", "state", search.propose(F.col("state"), target, F.lit(it)).alias("prompts")), "asked")
        rows = asked.select("target_id", F.posexplode("prompts").alias("place", "prompt"))
        told = score_prompts(rows, tvecs, "prompt", provider, "score", text_provider)
        scores = told.groupBy("target_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
        met = asked.join(scores, "target_id", "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<double>")))
        state = written(met.select("target_id", search.accept(F.col("state"), F.col("prompts"), F.col("scores"), target, F.lit(it))
                                   .cast(search.state).alias("state")), "round")
    return state


def _told(rows: DataFrame, prompt: str, score: str, rounds: Column, strategy: str) -> DataFrame:
    return rows.select("target_id", F.col(f"state.{prompt}").alias("prompt"), F.col(f"state.{score}").alias("score"),
                       rounds.alias("rounds"), F.lit(strategy).alias("strategy"))


def hill_climb(start: DataFrame, tvecs: DataFrame, config: RefineConfig = RefineConfig(), provider: EmbeddingProvider | None = None,
               text_provider: TextProvider | None = None) -> DataFrame:
    """start: (target_id, prompt, score)."""
    state = F.struct("prompt", "score", F.lit(0).alias("misses"), F.lit(0).alias("rounds"))
    done = run_search(hill_search(config), start.select("target_id", state.alias("state")), tvecs, config.iterations, provider, text_provider)
    return _told(done, "prompt", "score", F.col("state.rounds"), "hill_climbing")


def anneal(start: DataFrame, tvecs: DataFrame, config: RefineConfig = RefineConfig(), provider: EmbeddingProvider | None = None,
           text_provider: TextProvider | None = None) -> DataFrame:
    """start: (target_id, prompt, score)."""
    state = F.struct("prompt", "score", F.col("prompt").alias("best_prompt"), F.col("score").alias("best_score"))
    done = run_search(anneal_search(config), start.select("target_id", state.alias("state")), tvecs, config.iterations, provider, text_provider)
    return _told(done, "best_prompt", "best_score", F.lit(config.iterations), "simulated_annealing")


def _pooled(pool: DataFrame) -> DataFrame:
    """(target_id, pool): the candidates of a target by slot. As many as a
    target was given, so a bounded few. Dealt by a stated number of partitions:
    the rows are small, but each stands for a whole search, so they are not to
    be put together by their bytes."""
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pool.repartition(parts, "target_id").groupBy("target_id").agg(F.sort_array(F.collect_list(
        _entry(F.col("slot"), F.col("prompt"), F.col("score")))).cast(_POOL).alias("pool"))


def _beams(pool: DataFrame, config: RefineConfig) -> DataFrame:
    best = F.transform(F.slice(_ranked(F.col("pool")), 1, config.beam_width), lambda x, i: _entry(i + 1, x["prompt"], x["score"]))
    return _pooled(pool).select("target_id", F.struct(best.alias("beam"), F.array().cast("array<double>").alias("history")).alias("state"))


def beam_state(pool: DataFrame, tvecs: DataFrame, config: RefineConfig, provider: EmbeddingProvider | None = None,
               text_provider: TextProvider | None = None) -> DataFrame:
    """pool: (target_id, slot, prompt, score). (target_id, state) with the beam
    and the history of its best scores."""
    return run_search(beam_search_of(config), _beams(pool, config), tvecs, config.iterations, provider, text_provider)


def beam_search(pool: DataFrame, tvecs: DataFrame, config: RefineConfig = RefineConfig(), provider: EmbeddingProvider | None = None,
                text_provider: TextProvider | None = None) -> DataFrame:
    """The beam starts as the best ``beam_width`` of a target's candidates."""
    done = beam_state(pool, tvecs, config, provider, text_provider)
    top = done.select("target_id", F.get("state.beam", F.lit(0)).alias("state"))
    return _told(top, "prompt", "score", F.lit(config.iterations), "beam_search")


def beam_step(pool: DataFrame, tvecs: DataFrame, config: RefineConfig = RefineConfig()) -> DataFrame:
    """The beam after one round, a row per member: target_id, slot, prompt, score."""
    done = beam_state(pool, tvecs, replace(config, iterations=1))
    return done.select("target_id", F.inline_outer("state.beam")).withColumnRenamed("place", "slot")


def beam_history(pool: DataFrame, tvecs: DataFrame, config: RefineConfig = RefineConfig()) -> DataFrame:
    """target_id, iteration, score: the best of the beam after each round."""
    done = beam_state(pool, tvecs, config)
    return done.select("target_id", F.posexplode_outer("state.history").alias("iteration", "score"))


def running_best(history: DataFrame, patience: int = MAX_NO_IMPROVEMENT) -> DataFrame:
    """``history`` (target_id, iteration, score) with ``best_so_far``,
    ``streak``, the rounds since the best last rose, and ``stop_round``, the
    first round in which the streak reaches ``patience`` (null if none does).

    Rises part a target's rounds into islands; a round's place in its island is
    its streak. A target has as many rows as rounds, so its window is small."""
    rounds = Window.partitionBy("target_id").orderBy("iteration")
    before = F.max(F.round("score", 9)).over(rounds.rowsBetween(Window.unboundedPreceding, -1))
    told = history.withColumn("best_so_far", F.max("score").over(rounds.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn("_rise", F.coalesce(F.round("score", 9) > before, F.lit(True)).cast("int"))
    told = told.withColumn("_island", F.sum("_rise").over(rounds.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("target_id", "_island").orderBy("iteration")
    told = told.withColumn("streak", (F.row_number().over(island) - 1).cast("int"))
    stop = F.min(F.when(F.col("streak") >= patience, F.col("iteration"))).over(Window.partitionBy("target_id"))
    return told.withColumn("stop_round", stop).drop("_rise", "_island")


def evolve(pool: DataFrame, tvecs: DataFrame, config: RefineConfig = RefineConfig(), provider: EmbeddingProvider | None = None,
           text_provider: TextProvider | None = None) -> DataFrame:
    """pool: (target_id, slot, prompt, score), the first population; a target
    may start with fewer candidates than ``population``."""
    top = F.get(_ranked(F.col("pool")), F.lit(0))
    start = _pooled(pool).select("target_id", "pool", top.alias("top"))
    start = start.select("target_id", F.struct("pool", F.col("top.prompt").alias("best_prompt"), F.col("top.score").alias("best_score")).alias("state"))
    done = run_search(evolve_search(config), start, tvecs, config.iterations, provider, text_provider)
    return _told(done, "best_prompt", "best_score", F.lit(config.iterations), "evolutionary")


def simple_refine(pool: DataFrame) -> DataFrame:
    b = best_per_target(pool)
    return b.select("target_id", "prompt", "score", F.lit(0).alias("rounds"), F.lit("simple").alias("strategy"))


def refine(config: RefineConfig, pool: DataFrame, tvecs: DataFrame, provider: EmbeddingProvider | None = None,
           text_provider: TextProvider | None = None) -> DataFrame:
    """Dispatch by ``config.strategy``; pool: (target_id, slot, prompt, score)."""
    if config.strategy == "simple":
        return simple_refine(pool)
    if config.strategy in ("hill_climbing", "simulated_annealing"):
        first = pool.where(F.col("slot") == 1).select("target_id", "prompt", "score")
        run = hill_climb if config.strategy == "hill_climbing" else anneal
        return run(first, tvecs, config, provider, text_provider)
    run = beam_search if config.strategy == "beam_search" else evolve
    return run(pool, tvecs, config, provider, text_provider)


def compare_strategies(pool: DataFrame, tvecs: DataFrame, strategies=("simple", "hill_climbing", "evolutionary"),
                       config: RefineConfig = RefineConfig(), provider: EmbeddingProvider | None = None,
                       text_provider: TextProvider | None = None) -> DataFrame:
    """Scores of several strategies side by side, one row per target."""
    parts = [refine(replace(config, strategy=s), pool, tvecs, provider, text_provider).select("target_id", "strategy", "score") for s in strategies]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("target_id").pivot("strategy", list(strategies)).agg(F.first("score"))
