"""Column expressions: times, identities, roles, states, bins, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States by precedence, and what stands for none of them.
STATES = ("user_account", "mapped_product", "other_bot", "branch_movement_untyped")
NO_ACTION = "no_action_within_7d"
#: Days at which hazard bins begin and end.
HAZARD_DAYS = (0.0, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 14.0, 21.0, 30.0)


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body names it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def parse_time(text: Column | str, pattern: str = "yyyy-MM-dd'T'HH:mm:ssX") -> Column:
    """UTC time of an ISO text; bad text is null."""
    return F.try_to_timestamp(c(text), F.lit(pattern))


def seconds(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end, cut off towards zero."""
    return F.timestamp_diff("SECOND", c(start), c(end))


def hours(start: Column | str, end: Column | str) -> Column:
    return seconds(start, end) / 3600.0


def after(time: Column | str, **length: int) -> Column:
    """time plus days, hours, minutes or seconds."""
    return c(time) + F.expr("make_dt_interval({days}, {hours}, {minutes}, {seconds})".format(**({"days": 0, "hours": 0, "minutes": 0, "seconds": 0} | length)))


def valid_resolution(created: str = "created_dt", closed: str = "closed_dt", merged: str = "merged_dt") -> Column:
    """Closed, and neither closed nor merged before it was created."""
    return F.col(closed).isNotNull() & (F.col(closed) >= F.col(created)) & (F.col(merged).isNull() | (F.col(merged) >= F.col(created)))


def login(text: Column | str) -> Column:
    """Trimmed and lower-cased; nothing left is null."""
    return F.nullif(F.lower(F.trim(c(text))), F.lit(""))


def product_of(name: Column | str, aliases: dict[str, str]) -> Column:
    """The product of a login by exact, case-insensitive alias; null for others."""
    if not aliases:
        return F.lit(None).cast("string")
    table = F.create_map(*(F.lit(x) for k, v in aliases.items() for x in (k.lower(), v)))
    return F.try_element_at(table, F.lower(c(name)))


def repo_slug(text: Column | str) -> Column:
    """owner/name in lower case of a web, SSH or plain address; others are null."""
    s = F.regexp_replace(F.lower(F.trim(c(text))), r"^(https?://[^/]+/|git@[^:]+:|ssh://[^/]+/)(repos/)?", "")
    s = F.regexp_replace(F.regexp_replace(s, r"/+$", ""), r"\.git$", "")
    return F.when(s.rlike(r"^[a-z0-9_.-]+/[a-z0-9_.-]+$"), s)


def positive_number(text: Column | str) -> Column:
    n = c(text).try_cast("bigint")
    return F.when(n > 0, n)


def comment_reference(url: Column | str) -> Column:
    """struct(kind, number) of the fragment of a comment's address; null where there is none."""
    kind = F.regexp_extract(c(url), r"#(issuecomment|discussion_r|pullrequestreview)-?(\d+)$", 1)
    number = F.regexp_extract(c(url), r"#(issuecomment|discussion_r|pullrequestreview)-?(\d+)$", 2)
    return F.when(kind != "", F.struct(kind.alias("kind"), number.cast("bigint").alias("number")))


def public_comment(url: Column | str) -> Column:
    """struct(kind, public_id, fragment) of a comment's API address, fragments of issue comments included; null where there is none."""
    u = F.trim(c(url))
    review, issue = r"/pulls/comments/(\d+)(?:$|[/?#])", r"/issues/comments/(\d+)(?:-(\d+))?(?:$|[/?#])"

    def reference(kind: str, pattern: str, fragment: Column) -> Column:
        number = F.regexp_extract(u, pattern, 1)
        return F.when(number != "", F.struct(F.lit(kind).alias("kind"), number.cast("bigint").alias("public_id"), fragment.alias("fragment")))

    part = F.nullif(F.regexp_extract(u, issue, 2), F.lit("")).cast("bigint")
    return F.coalesce(reference("review_comment", review, F.lit(None).cast("bigint")), reference("issue_comment", issue, part))


def is_type(kind: str, user_type: Column | str = "user_type") -> Column:
    """Whether an account is of a type, whatever its case; an unknown type is none."""
    return F.coalesce(F.lower(c(user_type)) == kind, F.lit(False))


def actor_role(login_: str, agent: str, user_type: str, author_login: str, author_agent: str, trigger_agent: str) -> Column:
    """Who acts, seen from the item's author and from the triggering reviewer. Only a user can be the author's account."""
    mapped = F.col(agent)
    return (
        F.when(is_type("user", user_type) & (F.lower(login_) == F.lower(author_login)), "author_account")
        .when(mapped == F.col(author_agent), "author_agent_brand")
        .when(mapped == F.col(trigger_agent), "triggering_reviewer_brand")
        .when(mapped.isNotNull(), "other_agent_brand")
        .when(is_type("bot", user_type), "other_bot")
        .when(is_type("user", user_type), "other_human")
        .otherwise("unknown_actor")
    )


def owner(login_: str, agent: str, user_type: str, author_login: str, author_agent: str, trigger_agent: str, movement: Column | None = None) -> Column:
    """The nine owners of an action: people first, then products, then bots; accounts without a type own movements only."""
    moved = F.coalesce(movement, F.lit(False)) if movement is not None else F.lit(False)
    author, mapped, person = F.lower(login_) == F.lower(author_login), F.col(agent), is_type("user", user_type)
    return (
        F.when(person & author, "author_human")
        .when(person, "other_human")
        .when(mapped == F.col(author_agent), "author_agent")
        .when(mapped == F.col(trigger_agent), "triggering_reviewer")
        .when(mapped.isNotNull(), "other_agent")
        .when(is_type("bot", user_type), "other_bot")
        .when(moved & author, "author_account_untyped")
        .when(moved, "branch_actor_untyped")
        .otherwise("unknown")
    )


def atomic_state(agent: Column, user_type: Column) -> Column:
    """User over product over other bot; the rest is movement, or untyped."""
    return F.when(is_type("user", user_type), STATES[0]).when(agent.isNotNull(), STATES[1]).when(is_type("bot", user_type), STATES[2]).otherwise(STATES[3])


def state_priority(state: Column | str) -> Column:
    """Place of a state in the precedence; an unknown state fails."""
    table = F.create_map(*(F.lit(x) for i, s in enumerate(STATES) for x in (s, i)))
    return F.coalesce(F.try_element_at(table, c(state)), F.raise_error(F.concat(F.lit("unknown state: "), c(state))).cast("int"))


def transition_type(same_user: Column | str = "same_user", switched: Column | str = "switched") -> Column:
    """Four kinds of transition; an unknown contributor counts as another one."""
    user, brand = c(same_user), c(switched)
    return (
        F.when(user & ~brand, "persistence")
        .when(user & brand, "brand_change_same_contributor")
        .when(~user & ~brand, "contributor_change_stable_agent")
        .otherwise("joint_reconfiguration")
    )


def count_bin(n: Column | str) -> Column:
    n = c(n)
    return F.when(n.isNull(), "unknown").when(n == 0, "0").when(n < 10, "1-9").when(n < 100, "10-99").otherwise("100+")


def depth_bin(n: Column | str) -> Column:
    n = c(n)
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 4, "2-4").when(n <= 9, "5-9").otherwise("10+")


def logit(p: Column | str, eps: float = 1e-3) -> Column:
    q = F.greatest(F.least(c(p), F.lit(1 - eps)), F.lit(eps))
    return F.log(q / (1 - q))


def share(n: Column, of: Column) -> Column:
    """n / of; null over nothing."""
    return F.try_divide(n.cast("double"), of.cast("double"))


def e_value(risk_ratio: Column | str) -> Column:
    """The least confounding that explains a risk ratio away; ratios under 1 are turned over."""
    rr = F.when(c(risk_ratio) < 1, 1 / c(risk_ratio)).otherwise(c(risk_ratio))
    return rr + F.sqrt(rr * (rr - 1))


def risk_ratio(difference: Column | str, base: Column | str) -> Column:
    return F.try_divide(c(base) + c(difference), c(base))


def any_(flag: Column) -> Column:
    """bool_or that is false over nothing."""
    return F.coalesce(F.bool_or(flag), F.lit(False))


def all_(flag: Column) -> Column:
    """bool_and that is true over nothing."""
    return F.coalesce(F.bool_and(flag), F.lit(True))


def n_unique(x: Column | str) -> Column:
    """Distinct values, null being one."""
    return F.count_distinct(c(x)) + F.max(F.when(c(x).isNull(), 1).otherwise(0)).cast("bigint")


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def half_width(flag: Column, z: float = 1.96) -> Column:
    """Half the normal interval of a rate."""
    p = rate(flag)
    return z * F.sqrt(p * (1 - p) / F.count(flag))
