"""Files and records against the account registry.

``accounts``: account, bank, name, source (bank|pm), provider, channel, subco.  Joins are equi-joins on bank or provider plus an
anchor; the optimizer broadcasts the registry when its size allows and shuffles otherwise.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.functions import scalars as S
from ledgerline.functions import text as X


def _parts(files: DataFrame, words: DataFrame, key: str, word: str) -> DataFrame:
    """Distinct parts of each name that are as long as a word of its bank or provider."""
    lengths = words.groupBy(key).agg(F.collect_set(F.length(word)).alias("lengths"))  # a few numbers
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("raw") - n + 1), lambda i: F.substring(F.col("raw"), i, n))
    parts = F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length("raw")), cut)))
    return files.join(lengths, key).select("file_id", key, F.explode(parts).alias(word))


def describe_names(files: DataFrame) -> DataFrame:
    """Bank, provider and direction named by a file."""
    return files.select("file_id", "file_name", X.name_norm("file_name").alias("raw"), X.bank_from_name("file_name").alias("bank"),
                        X.provider_from_name("file_name").alias("provider"), X.direction_of_name("file_name").alias("direction"))


#: Words up to which all sets of an account's or a file's words are looked up.
SET_WORDS = 6


def _sets(words: Column) -> Column:
    """All non-empty sets of a short sorted array of distinct words."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(words)) - 1)
    return F.transform(masks, lambda m: F.filter(words, lambda _, i: F.getbit(m, i) == 1))


def _best_holders(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per file with any holder word in its name: the best score, its first account ``m``, the number of ``ties`` and, if above one, the accounts ``tied``.

    An account scores the words of its own that the name contains, each as often as it has it.  Accounts are summed up by each set of their
    words: the highest count of words that are in the set, and which accounts reach it.  A file looks up the sets of the words it contains.
    An account with the best score is found under one set that reaches it, that of all words it shares with the file, so common words
    cost a file some sets, not a row for each account.  Files and accounts of more than :data:`SET_WORDS` words, and files listed in
    several ways, meet account by account.
    """
    who = ["account", "subco", "ord"]
    spelled = accounts.select("bank", *who, F.explode(F.transform(X.name_words("name"), X.name_norm)).alias("word")).filter(F.length("word") >= 2)
    named = files.groupBy("file_id").agg(F.min(F.struct("bank", "raw")).alias("name"), F.max(F.struct("bank", "raw")).alias("other"), F.count(F.lit(1)).alias("copies"))
    one = named.filter("name = other").select("file_id", "name.bank", "name.raw", "copies")
    held = _parts(one, spelled.select("bank", "word").distinct(), "bank", "word").join(spelled.select("bank", "word").distinct(), ["bank", "word"])
    held = held.groupBy("file_id", "bank").agg(F.array_sort(F.collect_set("word")).alias("words"))
    few = F.size("words") <= SET_WORDS

    owners = spelled.groupBy("bank", *who).agg(F.collect_list("word").alias("all")).withColumn("words", F.array_sort(F.array_distinct("all")))
    reach = F.size(F.filter("all", lambda w: F.array_contains("set", w)))
    keys = owners.filter(few).withColumn("set", F.explode(_sets(F.col("words")))).withColumn("reach", reach)
    most = keys.groupBy("bank", "set", "reach").agg(F.count(F.lit(1)).alias("ties"), F.min("ord").alias("ord"), F.min_by(F.struct("account", "subco"), "ord").alias("m"))
    most = most.groupBy("bank", "set").agg(F.max_by(F.struct("reach", "ties", "ord", "m"), "reach").alias("k"))
    found = held.filter(few).withColumn("set", F.explode(_sets(F.col("words")))).join(most, ["bank", "set"]).join(one.select("file_id", "copies"), "file_id")
    found = found.select("file_id", (F.col("k.reach") * F.col("copies")).alias("score"), "k.ord", "k.m", "k.ties", F.struct("bank", "set", "k.reach").alias("place"))

    long = owners.filter(~few).select("bank", *who, F.explode("all").alias("word"))
    several = files.join(named.filter("name <> other").select("file_id"), "file_id", "left_semi").select("file_id", "bank", "raw")
    # A file that meets all accounts one by one: many words, or several names; others meet the long accounts only.
    apart = (_parts(several, spelled, "bank", "word").join(spelled, ["bank", "word"])
             .unionByName(held.filter(~few).join(one.select("file_id", "copies"), "file_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
                          .select("file_id", "bank", F.explode("words").alias("word")).join(spelled, ["bank", "word"]))
             .unionByName(held.filter(few).join(one.select("file_id", "copies"), "file_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
                          .select("file_id", "bank", F.explode("words").alias("word")).join(long, ["bank", "word"])))
    apart = apart.groupBy("file_id", *who).agg(F.count(F.lit(1)).alias("score"))
    single = apart.select("file_id", "score", "ord", F.struct("account", "subco").alias("m"), F.lit(1).cast("bigint").alias("ties"), F.lit(None).cast(found.schema["place"].dataType).alias("place"))
    best = found.unionByName(single).groupBy("file_id", "score").agg(F.min_by("m", "ord").alias("m"), F.sum("ties").alias("ties"), F.collect_list("place").alias("places"))
    best = best.groupBy("file_id").agg(F.max_by(F.struct("score", "m", "ties", "places"), "score").alias("t")).select("file_id", "t.*")
    shared = best.filter("ties > 1")
    tied = (shared.select("file_id", F.inline("places")).join(keys, ["bank", "set", "reach"]).select("file_id", "account")
            .unionByName(apart.join(shared.select("file_id", "score"), ["file_id", "score"]).select("file_id", "account")))
    tied = tied.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("account")), ",").alias("tied"))
    return best.drop("places").join(tied, "file_id", "left")


def match_files(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """The registry row a file name points to, or the reason why there is none.

    A gateway file needs the provider and a sub-company: contained in the name, else its short form (trailing digits
    dropped) as a whole word if that is unique.  A bank file scores registry rows by the holder words its name contains;
    ties are reported and go to the first row of the registry, whose order is ``ord``.  A name is cut into its parts of the lengths
    that registry words have, and parts and words meet in an equi-join, so only real containments become rows, one for each word.
    """
    f = describe_names(files)
    if "ord" not in accounts.columns:
        raise ValueError("accounts need ord, the registry's order, to decide ties")
    pm = accounts.filter("source = 'pm'").select("provider", "subco", "channel", "ord", X.name_norm("subco").alias("sub"))
    pm_files = f.filter("provider is not null")
    subs = pm.filter(F.length("sub") >= 2)
    full = (_parts(pm_files, subs, "provider", "sub").join(subs, ["provider", "sub"]).groupBy("file_id").agg(F.min_by(F.struct("subco", "channel"), "ord").alias("hit")))
    words = pm_files.select("file_id", "provider", F.explode(F.array_distinct(X.name_tokens("file_name"))).alias("short"))
    short = (words.join(pm.withColumn("short", F.regexp_replace("sub", r"\d+$", "")).filter(F.length("short") >= 2), ["provider", "short"])
             .groupBy("file_id").agg(F.min_by(F.struct("subco", "channel"), "ord").alias("hit"), F.count_distinct("subco").alias("n"))
             .filter("n = 1").select("file_id", F.col("hit").alias("short_hit")))
    choices = pm.groupBy("provider").agg(F.array_join(F.array_sort(F.collect_set("subco")), ",").alias("choices"))
    pm_out = (pm_files.join(full, "file_id", "left").join(short, "file_id", "left").join(choices, "provider", "left")
              .withColumn("m", F.coalesce("hit", "short_hit")).select(
        "file_id", "direction", F.col("m.subco").alias("subco"), F.when(F.col("m").isNotNull(), F.col("provider")).alias("match_provider"),
        F.col("m.channel").alias("channel"), F.lit(None).cast("string").alias("match_bank"), F.lit(None).cast("string").alias("account"),
        F.when(F.col("m").isNotNull(), "pm").alias("source"), F.when(F.col("m").isNotNull(), 2).alias("score"),
        F.when(F.col("m").isNull(), F.col("choices")).alias("ambiguous"), F.when(F.col("m").isNull(), fixed.REASON_PM_NO_SUBCO).alias("reason")))

    bank_files = f.filter("provider is null and bank is not null")
    top = _best_holders(bank_files, accounts.filter("source = 'bank'"))
    bank_out = bank_files.join(top, "file_id", "left").select(
        "file_id", "direction", F.col("m.subco").alias("subco"), F.lit(None).cast("string").alias("match_provider"), F.lit(None).cast("string").alias("channel"),
        F.when(F.col("m").isNotNull(), F.col("bank")).alias("match_bank"), F.col("m.account").alias("account"),
        F.when(F.col("m").isNotNull(), "bank").alias("source"), F.col("score").cast("int").alias("score"),
        F.when(F.col("ties") > 1, F.col("tied")).alias("ambiguous"), F.when(F.col("m").isNull(), fixed.REASON_BANK_NO_NAME).alias("reason"))

    none = f.filter("provider is null and bank is null").select(
        "file_id", "direction", *[F.lit(None).cast("string").alias(c) for c in ("subco", "match_provider", "channel", "match_bank", "account", "source")],
        F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("ambiguous"), F.lit(fixed.REASON_UNKNOWN).alias("reason"))
    return pm_out.unionByName(bank_out).unionByName(none)


def account_lookup(rows: DataFrame, accounts: DataFrame, column: str = "account") -> DataFrame:
    """Registry columns of an account number; both spellings (with and without the wallet zero) count."""
    digits = X.normalize_account(column, F.lit(None).cast("string"))
    plain = X.normalize_account("account", F.lit(None).cast("string"))
    known = accounts.filter(S.blank_to_null("account").isNotNull()).select(
        plain.alias("__digits"), F.col("subco").alias("reg_subco"), F.col("bank").alias("reg_bank"), F.col("account").alias("reg_account"))
    known = known.groupBy("__digits").agg(*[F.min_by(c, "reg_account").alias(c) for c in ("reg_subco", "reg_bank", "reg_account")])
    return rows.withColumn("__digits", digits).join(known, "__digits", "left").drop("__digits")


def tag_records(txns: DataFrame, matches: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Attach what the file name says: gateway rows use their canonical name as account and channel, an unknown account is
    filled from the file, other accounts are reduced to digits, a missing bank or sub-company is filled."""
    m = matches.select("file_id", F.col("subco").alias("tag_subco"), F.col("account").alias("tag_account"), F.col("match_bank").alias("tag_bank"))
    t = txns.join(m, "file_id", "left")
    gateway = X.canonical_pm(F.coalesce(S.blank_to_null("channel"), F.col("account")))
    unknown = F.coalesce(F.col("account") == "UNKNOWN", F.lit(True)) & F.col("tag_account").isNotNull()
    bank = F.coalesce("tag_bank", "bank")
    account = (F.when(gateway.isNotNull(), gateway).when(unknown, X.normalize_account("tag_account", bank))
               .when(F.col("account").rlike(r"\d"), X.normalize_account("account", bank)).otherwise(F.col("account")))
    return (t.withColumn("new_account", account).withColumn("channel", F.coalesce(gateway, "channel"))
            .withColumn("bank", F.coalesce(S.blank_to_null("bank"), "tag_bank")).withColumn("subco", F.coalesce(S.blank_to_null("subco"), "tag_subco"))
            .withColumn("account", F.col("new_account")).drop("new_account", "tag_subco", "tag_account", "tag_bank"))


def register_unseen(headers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Statement accounts missing from the master list, as active registry rows."""
    seen = headers.filter(S.blank_to_null("account").isNotNull()).groupBy("account").agg(
        F.min("bank").alias("bank"), F.min("holder").alias("holder"))
    return seen.join(accounts.select("account"), "account", "left_anti").withColumn("active", F.lit(True))
