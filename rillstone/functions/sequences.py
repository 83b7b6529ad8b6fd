"""Per-token series as array expressions: masks, KL, advantages, returns, importance weights.

Everything stays in higher-order functions; a row is one sequence, so nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillstone.functions.text import let


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def masked_sum(x: Column, mask: Column) -> Column:
    """Sum of x where the mask is not 0; a null mask counts every token."""
    return F.when(mask.isNull(), _sum(F.transform(x, lambda v: v.cast("double")))).otherwise(_sum(F.zip_with(x, mask, lambda v, m: v.cast("double") * m)))


def masked_mean(x: Column, mask: Column) -> Column:
    """masked_sum over the number of unmasked tokens, at least 1."""
    n = F.when(mask.isNull(), F.size(x).cast("double")).otherwise(_sum(F.transform(mask, lambda m: m.cast("double"))))
    return masked_sum(x, mask) / F.greatest(n, F.lit(1.0))


def kl(logp: Column, ref: Column, kind: str = "k1") -> Column:
    """Elementwise KL estimates; k3 and low_var_kl are never negative, the latter kept within 10."""
    forms = {
        "k1": lambda d: d,
        "k2": lambda d: d * d / 2,
        "k3": lambda d: F.exp(-d) - 1 + d,
        "low_var_kl": lambda d: F.least(F.greatest(F.exp(-d) - 1 + d, F.lit(-10.0)), F.lit(10.0)),
    }
    if kind not in forms:
        raise ValueError(f"unknown KL form {kind!r}")
    return F.zip_with(logp, ref, lambda a, b: forms[kind](a.cast("double") - b.cast("double")))


def reverse_scan(x: Column, decay: float) -> Column:
    """y_t = x_t + decay * y_{t+1}, from the end."""
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).alias("last"))

    def step(acc: Column, v: Column) -> Column:
        now = v + F.lit(decay) * acc["last"]
        return F.struct(F.array_append(acc["done"], now).alias("done"), now.alias("last"))

    return F.aggregate(F.reverse(x), start, step, lambda acc: F.reverse(acc["done"]))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates: delta_t = r_t + gamma v_{t+1} - v_t, then a scan with gamma * lam."""
    ahead = F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0.0)))
    gain = F.zip_with(rewards, ahead, lambda r, v: r.cast("double") + F.lit(gamma) * v)
    return reverse_scan(F.zip_with(gain, values, lambda g, v: g - v), gamma * lam)


def discounted_returns(reward: Column, kl_terms: Column, mask: Column, kl_coef: float, gamma: float) -> Column:
    """Token returns: -kl_coef * kl everywhere, the reward on the last unmasked token, discounted back.
    A fully masked sequence gives null."""
    last = F.size(mask) - F.array_position(F.reverse(F.transform(mask, lambda m: (m != 0).cast("int"))), 1) + 1
    token = let(last, lambda n: F.transform(kl_terms, lambda k, i: -F.lit(kl_coef) * k + F.when(i + 1 == n, reward.cast("double")).otherwise(0.0)))
    return F.when(F.exists(mask, lambda m: m != 0), reverse_scan(token, gamma))


def group_returns(reward: Column, like: Column) -> Column:
    """The sequence's reward on every token."""
    return F.array_repeat(reward.cast("double"), F.size(like))


def baseline_advantages(reward: Column, kl_terms: Column, kl_coef: float) -> Column:
    return F.transform(kl_terms, lambda k: reward.cast("double") - F.lit(kl_coef) * k)


def policy_loss(ratio_log: Column, advantage: Column, low: float, high: float, dual: float | None = None) -> Column:
    """Clipped objective per token: (loss, clipped) for ratio exp(-ratio_log)."""
    if dual is not None and dual <= 1.0:
        raise ValueError("the dual clip must exceed 1")

    def one(p: Column, a: Column) -> Column:
        r = F.exp(-p)
        free, held = -r * a, -F.least(F.greatest(r, F.lit(1.0 - low)), F.lit(1.0 + high)) * a
        loss = F.greatest(free, held)
        if dual is not None:
            loss = F.when(a < 0, F.least(F.lit(-dual) * a, loss)).otherwise(loss)
        return F.struct(loss.alias("loss"), (held > free).cast("int").alias("clipped"))

    return F.zip_with(ratio_log, advantage, one)


def value_loss(values: Column, old: Column, returns: Column, clip: float) -> Column:
    """Per token the larger of the plain and the clipped squared error."""
    both = F.arrays_zip(values.alias("v"), old.alias("o"), returns.alias("r"))

    def one(x: Column) -> Column:
        held = x["o"] + F.least(F.greatest(x["v"] - x["o"], F.lit(-clip)), F.lit(clip))
        return F.greatest((held - x["r"]) * (held - x["r"]), (x["v"] - x["r"]) * (x["v"] - x["r"]))

    return F.transform(both, one)


def importance_weights(train: Column, rollout: Column, mask: Column, level: str = "token", mode: str = "truncate", low: float = 0.5, high: float = 2.0, veto: float | None = None) -> Column:
    """Bounded importance weights per token.

    level: token, sequence (summed log-ratio) or geometric (mean log-ratio); log-ratios are kept
    within 20 before exp. mode: truncate to [0, high], clip to [low, high], or mask values outside.
    With veto, a sequence with a token below log(veto) gets weight 0. Masked tokens get 0.
    """
    import math

    d = F.zip_with(train, rollout, lambda a, b: a.cast("double") - b.cast("double"))
    if level == "token":
        logs = d
    elif level in ("sequence", "geometric"):
        whole = masked_sum(d, mask) if level == "sequence" else masked_mean(d, mask)
        logs = F.array_repeat(whole, F.size(d))
    else:
        raise ValueError(f"unknown level {level!r}")
    w = F.transform(logs, lambda x: F.exp(F.least(F.greatest(x, F.lit(-20.0)), F.lit(20.0))))
    bound = {
        "truncate": lambda x: F.least(x, F.lit(high)),
        "clip": lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)),
        "mask": lambda x: F.when((x >= low) & (x <= high), x).otherwise(0.0),
    }
    if mode not in bound:
        raise ValueError(f"unknown mode {mode!r}")
    out = F.zip_with(F.transform(w, bound[mode]), mask, lambda x, m: x * m)
    if veto is not None:
        bad = F.exists(F.zip_with(d, mask, lambda x, m: (x < F.lit(math.log(veto))) & (m != 0)), lambda b: b)
        out = F.when(bad, F.transform(out, lambda x: F.lit(0.0))).otherwise(out)
    return out


def mismatch_metrics(train: Column, rollout: Column, mask: Column) -> dict[str, Column]:
    """Perplexities of both sides, their log difference, and KL and chi-square estimates per sequence."""
    d = F.zip_with(train, rollout, lambda a, b: F.least(F.greatest(a.cast("double") - b.cast("double"), F.lit(-20.0)), F.lit(20.0)))
    lp, lr = -masked_mean(train, mask), -masked_mean(rollout, mask)
    return {
        "train_ppl": F.exp(lp), "rollout_ppl": F.exp(lr), "log_ppl_diff": lr - lp, "log_ppl_abs_diff": F.abs(lr - lp), "ppl_ratio": F.exp(lp - lr), "kl": masked_mean(F.transform(d, lambda x: -x), mask),
        "k3_kl": masked_mean(F.transform(d, lambda x: F.exp(x) - x - 1), mask), "chi2_token": masked_mean(F.transform(d, lambda x: F.exp(2 * x)), mask) - 1, "chi2_seq": F.exp(F.least(2 * masked_sum(d, mask), F.lit(40.0))) - 1,
    }


def response_length(mask: Column) -> Column:
    """Tokens from the first unmasked one on; 0 if there is none."""
    at = F.array_position(F.transform(mask, lambda m: (m != 0).cast("int")), 1)
    return F.when(at > 0, F.size(mask) - at + 1).otherwise(F.lit(0)).cast("int")


def tail(x: Column, n: Column) -> Column:
    """The last n elements."""
    return F.when(n > 0, F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)).cast("int"), n.cast("int"))).otherwise(F.slice(x, 1, 0))


def chat_loss_mask(messages: Column, length) -> Column:
    """1 for each token of an assistant message and 0 for the rest; length: column function giving a message's tokens."""
    per = F.transform(messages, lambda m: F.array_repeat((m["role"] == "assistant").cast("int"), length(m).cast("int")))
    return F.flatten(per)


def distillation_advantages(student: Column, teacher: Column) -> Column:
    """Teacher less student log-probability per response token; the teacher's series may open with the prompt's tokens."""
    return F.zip_with(tail(teacher, F.size(student)), student, lambda t, s: t.cast("double") - s.cast("double"))


def advantages(
    estimator: str, reward: Column, logp: Column | None = None, ref: Column | None = None, mask: Column | None = None, values: Column | None = None, teacher: Column | None = None,
    kl_coef: float = 0.0, kl_kind: str = "k1", gamma: float = 1.0, lam: float = 1.0,
) -> Column:
    """(advantages, returns) per token by the named estimator: grpo, gspo, ppo, reinforce_plus_plus,
    reinforce_plus_plus_baseline or on_policy_distillation.

    The KL against ref counts 0 where kl_coef is 0 or there are no log-probabilities. Whitening over
    all sequences is a second step.
    """
    needed = {"grpo": [], "gspo": [], "ppo": ["values"], "reinforce_plus_plus": ["mask"], "reinforce_plus_plus_baseline": [], "on_policy_distillation": ["logp", "teacher"]}
    if estimator not in needed:
        raise ValueError(f"unknown estimator {estimator!r}")
    given = {"logp": logp, "ref": ref, "mask": mask, "values": values, "teacher": teacher}
    penal = bool(kl_coef) and logp is not None and estimator != "on_policy_distillation"
    missing = [n for n in needed[estimator] + ["ref"] * penal if given[n] is None]
    if missing or (logp is None and values is None):
        raise ValueError(f"{estimator} needs {missing or 'logp or values'}")
    like = logp if logp is not None else values
    terms = kl(logp, ref, kl_kind) if penal else F.transform(like, lambda x: F.lit(0.0))
    if estimator in ("grpo", "gspo"):
        a = r = group_returns(reward, like)
    elif estimator == "ppo":
        token = F.transform(terms, lambda k, i: -F.lit(kl_coef) * k + F.when(i + 1 == F.size(like), reward.cast("double")).otherwise(0.0))
        a = gae(token, values, gamma, lam)
        return let(a, lambda x: F.struct(x.alias("advantages"), F.zip_with(x, values, lambda p, v: p + v.cast("double")).alias("returns")))
    elif estimator == "reinforce_plus_plus":
        a = r = discounted_returns(reward, terms, mask, kl_coef, gamma)
    elif estimator == "reinforce_plus_plus_baseline":
        a = r = baseline_advantages(reward, terms, kl_coef)
    else:
        a = r = distillation_advantages(logp, teacher)
    return let(a, lambda x: F.struct(x.alias("advantages"), x.alias("returns")))
