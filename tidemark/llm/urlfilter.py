"""URL filters: explicit rules, then a naive Bayes verdict on segmented names.

Host labels are concatenations of words more often than not. A unigram Viterbi pass
splits each run of letters into its likeliest words; a multinomial naive Bayes model
scores the words of host and path. Rules (host suffix and path prefix) come first.

Unigram counts are taken over every url of the table, from tokens that the url itself
delimits (path tokens, parts of hyphenated labels); they stay a staged table. Urls are
dealt to blocks, and each block gets the counts of the words that its names contain:
all stretches of up to ``LONGEST_WORD`` letters, the bound that the DNS sets to a label,
and each whole run, however long. Nothing is left out for being rare.

The classifier is fitted on labelled examples: ``EXAMPLES`` and ``PATH_EXAMPLES``, names of
hosts and of folders that were labelled by kind, and a table of labelled urls if the
caller has one, of which up to ``sample`` rows of least hash are taken; :func:`evidence`
makes such a table from pages' own html. A word weighs as the labels of the names that
hold it say, for or against, in a host and in a path apart; a name means in a path what it
means in a host, so each example counts in both places. ``PRIOR`` is the share of urls
expected to be unwanted. The rules are no labels: they go by domain and folder, which says
nothing on a name. Scoring covers every row.

A null url, or one without ``://``, has an empty host and path; an empty host is allowed
unless a rule says otherwise. Repeated rows are judged alike. Urls of any length are
handled whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import shuffle_width, stage

#: Example hosts with their labels, words set apart by hyphens.
EXAMPLES = {
    "block": """
        casino-royal-bonus lucky-casino online-casino-games casino-slots vegas-casino best-casino-bonus poker-room online-poker
        poker-stars-bonus free-poker slots-jackpot free-slots mega-slots jackpot-wheel jackpot-win lucky-jackpot sports-betting
        betting-tips live-betting bet-now bet-and-win football-bets sure-bets daily-bets bingo-bonus roulette-win gambling-guide
        online-gambling adult-video adult-chat adult-cams free-adult adult-toys adult-dating porn-tube free-porn hot-porn porn-hd
        sex-cams live-sex sex-chat xxx-video xxx-tube teen-xxx nude-cams escort-girls escort-service hot-escort cheap-viagra
        buy-viagra viagra-store diet-pills cheap-pills-store buy-pills pills-online pharma-discount online-pharma cheap-pharma
        ads-server ads-network click-ads pop-ads ads-tracker pop-under-ads click-tracker track-click track-pixel tracking-pixel
        click-farm spam-mailer bulk-spam spam-links link-spam warez-download warez-forum free-warez torrent-tracker torrent-download
        free-torrent movie-torrent crack-download serial-crack keygen-crack payday-loans fast-payday payday-cash instant-loans
        cheap-loans malware-download spam-bots spam-list link-farm comment-spam live-casino betting-odds sports-bets gambling-online viagra-online warez-links""",
    "allow": """
        news-daily morning-news city-news local-news sports-news football-club football-results university-press state-university
        science-journal science-news garden-farm family-farm organic-farm wind-farm farm-shop free-software free-library
        free-recipes cheap-flights cheap-hotels track-club race-track track-parcel mail-server online-shop book-store online-store
        web-design mobile-games board-games video-news music-video chat-support travel-blog food-blog my-blog home-garden
        house-design train-tickets weather-map city-map museum-art art-gallery public-library health-clinic city-pharmacy
        bank-online savings-bank home-loan-advice job-search school-board language-school music-school cooking-recipes
        bread-recipes bike-shop car-parts film-review book-review open-source download-manual linux-forum garden-forum
        history-archive photo-album hotel-guide city-guide language-guide match-day chess-club swim-team hiking-tips""",
}
#: Example folders and pages with their labels.
PATH_EXAMPLES = {
    "block": """
        free-spins/casino-bonus slots/jackpot casino/sign-up-bonus poker/free-chips betting/live-odds bets/today roulette/play bingo/win
        adult/cams porn/videos xxx/gallery escorts/city nude/photos sex/chat-live viagra/order pills/no-prescription pharma/cheap-meds
        ads/click click/redirect track/pixel tracker/click-id popup/ads out/affiliate-link affiliate/redirect spam/send-bulk
        warez/crack torrent/download-free keygen/serial crack/full-version payday/cash-now loans/instant-approval malware/setup-exe
        get-rich/quick-money win-prize/claim-now claim/free-gift lucky-winner/claim""",
    "allow": """
        news/politics news/sport news/local articles/science archive/history blog/travel blog/recipes docs/manual docs/install
        help/contact about/team products/garden shop/books shop/bikes library/catalogue museum/exhibitions school/timetable
        university/research courses/language health/advice weather/forecast maps/city jobs/search forum/linux wiki/physics
        reviews/films music/concerts sport/results football/fixtures events/calendar recipes/bread press/releases
        gallery/paintings download/report track/parcel-status tickets/train account/settings""",
}
PRIOR, SMOOTHING = 0.1, 0.1
#: Frequent parts of names beside the table's own tokens.
COMMON_WORDS = "best blog buy cheap fast free go home mail my news now online shop store the top web win www your".split()
LETTERS = re.compile(r"[a-z]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST_WORD = 63
SAMPLE = 20_000
#: Words of the table that go to the tasks as a list (some MB): so few, and stretches that are no words stay where they are.
LISTED_WORDS = 200_000
#: Urls of a block, on average; words that a mapper holds before it sends them on.
BLOCK_ROWS, SEND_WORDS = 10_000, 200_000


def examples() -> list[tuple[list[str], bool]]:
    """Tokens and label (true: block) of each example host, then of the same names and of the example paths as paths."""
    words = lambda name: name.replace("/", "-").split("-")
    named = lambda table, place: [([place + w for w in words(name)], label == "block") for label, names in table.items() for name in names.split()]
    return named(EXAMPLES, "h:") + named(EXAMPLES, "p:") + named(PATH_EXAMPLES, "p:")


def host_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Rules:
    """(verdict, rule) pairs; a rule is a host and a path, like ``example.com/en/``."""

    by_host: dict[str, list[tuple[str, str, str]]] = field(default_factory=dict)

    @classmethod
    def of(cls, pairs: list[tuple[str, str]]) -> Rules:
        out = cls()
        for verdict, rule in pairs:
            host, slash, path = rule.partition("/")
            out.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        return out

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict."""
        found: tuple[int, str | None, str | None] = (-1, None, None)
        suffix = host
        while True:
            for prefix, rule, verdict in self.by_host.get(suffix, ()):
                if path.startswith(prefix) and len(rule) > found[0]:
                    found = (len(rule), rule, verdict)
            _, dot, suffix = suffix.partition(".")
            if not dot:
                return found[1], found[2]


class Segmenter:
    """Unigram Viterbi: the split of a name into words of greatest probability."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(c / self.total) for w, c in counts.items() if c > 0}
        self.unknown = math.log(self.total) + 2.0
        self._seen: dict[str, tuple[str, ...]] = {}

    def split(self, name: str) -> tuple[str, ...]:
        if name not in self._seen:
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[name] = self._viterbi(name)
        return self._seen[name]

    def cost_of(self, word: str) -> float:
        """-ln of the word's probability; an unknown stretch costs more with each letter."""
        cost = self.cost.get(word)
        return self.unknown + 1.5 * len(word) if cost is None else cost

    def _viterbi(self, name: str) -> tuple[str, ...]:
        n = len(name)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            starts = range(max(0, end - LONGEST_WORD), end)
            for start in starts if end < n or not starts.start else (0, *starts):
                cost = self.cost_of(name[start:end])
                if best[start] + cost < best[end]:
                    best[end], back[end] = best[start] + cost, start
        words, end = [], n
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(words))

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host (marked ``h:``) and of the path (``p:``)."""
        out = ["h:" + w for run in LETTERS.findall(host) for w in self.split(run)]
        return out + ["p:" + w for run in LETTERS.findall(path.lower()) for w in self.split(run)]


class NaiveBayes:
    """Multinomial, every count ``smoothing`` higher; positive log odds mean block. Words without a label say nothing."""

    def __init__(self, labelled, prior: float = PRIOR, smoothing: float = SMOOTHING):
        counts = {True: Counter(), False: Counter()}
        for tokens, blocked in labelled:
            counts[blocked].update(tokens)
        words = set(counts[True]) | set(counts[False])
        size = {k: sum(c.values()) + smoothing * len(words) for k, c in counts.items()}
        self.prior = math.log(prior / (1 - prior))
        share = lambda w, k: (counts[k][w] + smoothing) / size[k]
        self.odds = {w: math.log(share(w, True) / share(w, False)) for w in words}

    def score(self, tokens: list[str]) -> float:
        return self.prior + sum(self.odds.get(t, 0.0) for t in tokens)


@dataclass
class UrlModel:
    """``unigrams``: staged (word, count) of all words, ``total``: the sum of their counts."""

    unigrams: DataFrame
    total: int
    bayes: NaiveBayes


def count_words(urls: DataFrame) -> tuple[DataFrame, int]:
    """Staged (word, count) of all delimited tokens and the fixed words, and the sum of the counts."""
    hyphenated = F.filter(F.split("host", r"\."), lambda x: x.contains("-"))
    delimited = F.concat(F.regexp_extract_all(F.array_join(hyphenated, "-"), F.lit("[a-z]+"), 0), F.regexp_extract_all(F.lower("path"), F.lit("[a-z]+"), 0))
    counts = urls.select(F.explode(delimited).alias("word")).groupBy("word").count()
    counts = stage(counts)
    floor = max(10, (counts.agg(F.sum("count")).first()[0] or 0) // 1000)
    fixed = F.explode(F.array(*[F.lit(w) for w in sorted({*COMMON_WORDS, *(t[2:] for tokens, _ in examples() for t in tokens)})]))
    fixed = urls.sparkSession.range(1).select(fixed.alias("word"), F.lit(floor).cast("long").alias("count"))
    unigrams = stage(counts.union(fixed).groupBy("word").agg(F.max("count").alias("count")))
    return unigrams, unigrams.agg(F.sum("count")).first()[0]


def _substrings(listed: frozenset[str] | None):
    """(block, word): each (block, name) and all its stretches of up to LONGEST_WORD letters, most repeats left out; only ``listed`` ones, if there is a list."""
    names = ["block", "word"]
    send = lambda found: pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([w for _, w in found], pa.string())], names=names)

    def run(batches):
        found = set()
        for batch in batches:
            for block, name in zip(batch.column("block").to_pylist(), batch.column("name").to_pylist(), strict=True):
                found.add((block, name))
                for start in range(len(name)):
                    some = (name[start:end] for end in range(start + 1, min(start + LONGEST_WORD, len(name)) + 1))
                    found.update((block, w) for w in some if listed is None or w in listed)
                    if len(found) >= SEND_WORDS:
                        yield send(found)
                        found = set()
        if found:
            yield send(found)

    return run


def _listed(unigrams: DataFrame) -> frozenset[str] | None:
    """All words, if they are few and not long; None if they are not."""
    n, size = unigrams.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    return frozenset(r.word for r in unigrams.select("word").collect()) if n <= LISTED_WORDS and (size or 0) <= 16 * LISTED_WORDS else None


def _by_block(urls: DataFrame, unigrams: DataFrame, judge, schema: str) -> DataFrame:
    """``judge(rows, words)`` of each block: its rows of ``urls`` and the counts of all words that its names contain."""
    blocks = max(shuffle_width(urls.sparkSession), 1 + urls.count() // BLOCK_ROWS)
    urls = urls.withColumn("block", F.pmod(F.xxhash64(*urls.columns), F.lit(blocks)).cast("long"))
    runs = lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), 0)
    names = urls.select("block", F.explode(F.array_distinct(F.concat(runs("host"), runs(F.lower("path"))))).alias("name")).distinct()
    asked = names.mapInArrow(_substrings(_listed(unigrams)), "block long, word string").distinct()
    words = asked.join(unigrams, "word").select("block", "word", "count")
    return urls.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(judge, schema)


def _segmenter(words: pa.Table, total: int) -> Segmenter:
    return Segmenter(dict(zip(words["word"].to_pylist(), words["count"].to_pylist(), strict=True)), total)


def _tokens(total: int):
    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        segmenter = _segmenter(words, total)
        tokens = [segmenter.tokens(h, p) for h, p in zip(rows["host"].to_pylist(), rows["path"].to_pylist(), strict=True)]
        return pa.table({"tokens": pa.array(tokens, pa.list_(pa.string())), "blocked": rows["blocked"]})

    return run


def fit(pages: DataFrame, url_column: str = "url", labelled: DataFrame | None = None, sample: int = SAMPLE) -> UrlModel:
    """The model of the table's names. ``labelled`` (url, blocked) adds up to ``sample`` rows to the examples."""
    split = lambda df, column, *more: df.select(host_of(column).alias("host"), path_of(column).alias("path"), *more)
    unigrams, total = count_words(split(pages, url_column))
    known = examples()
    if labelled is not None:
        rows = labelled.filter("blocked is not null").orderBy(F.xxhash64("url"), "url", "blocked").limit(sample)
        rows = stage(split(rows, "url", "blocked"))
        found = _by_block(rows, unigrams, _tokens(total), "tokens array<string>, blocked boolean").collect()
        known += [(r.tokens, r.blocked) for r in found]
    return UrlModel(unigrams, total, NaiveBayes(known))


def evidence(pages: DataFrame, url_column: str = "url", html_column: str = "html", least_words: int = 10, most_repeated: float = 0.2) -> DataFrame:
    """(url, blocked) from the pages' own text: blocked are those of few words, or whose sentences repeat.

    What a page shows is its html without scripts, styles and tags; a page without html says nothing.
    """
    shown = F.regexp_replace(F.col(html_column), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    shown = F.regexp_replace(shown, r"(?s)<[^>]*>", " ")
    sentences = F.transform(F.filter(F.split(shown, r"[.!?\n]+"), lambda s: s.rlike(r"\S")), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    rows = pages.filter(F.col(html_column).isNotNull()).select(F.col(url_column).alias("url"), F.size(F.regexp_extract_all(shown, F.lit(r"\S+"), F.lit(0))).alias("n"), sentences.alias("s"))
    repeated = (F.size("s") - F.size(F.array_distinct("s"))) > most_repeated * F.size("s")
    return rows.select("url", ((F.col("n") < least_words) | repeated).alias("blocked"))


def held_out(labelled: DataFrame, tenth: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(blocked, verdict, n): verdicts on a tenth of ``labelled`` (url, blocked), by a hash of the host, of a model fitted on the others."""
    part = F.pmod(F.xxhash64(host_of("url")), F.lit(10))
    model = fit(labelled, labelled=labelled.filter(part != tenth), sample=sample)
    rest = labelled.filter(part == tenth).select(F.col("blocked").cast("int").alias("page_id"), "url")
    return judge(rest, [], model).groupBy((F.col("page_id") == 1).alias("blocked"), "verdict").agg(F.count("*").alias("n"))


def _judge(bayes: NaiveBayes, total: int, rules: Rules):
    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        segmenter = _segmenter(words, total)
        chosen, verdicts, tokens = [], [], []
        for host, path in zip(rows["host"].to_pylist(), rows["path"].to_pylist(), strict=True):
            rule, verdict = rules.match(host, path)
            split = segmenter.tokens(host, path)
            chosen.append(rule)
            tokens.append(split)
            verdicts.append(verdict or ("block" if host and bayes.score(split) > 0 else "allow"))
        rows = rows.drop_columns(["block"])
        for name, column in (("rule", pa.array(chosen, pa.string())), ("verdict", pa.array(verdicts, pa.string())), ("tokens", pa.array(tokens, pa.list_(pa.string())))):
            rows = rows.append_column(name, column)
        return rows

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel | None = None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule (null if none fits), verdict and tokens of each row."""
    model = model or fit(pages, url_column)
    urls = pages.select(F.col(id_column), host_of(url_column).alias("host"), path_of(url_column).alias("path"))
    kind = urls.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, host string, path string, rule string, verdict string, tokens array<string>"
    return _by_block(urls, model.unigrams, _judge(model.bayes, model.total, Rules.of(rules)), schema)
