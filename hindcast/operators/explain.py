"""What a fired rule says: one sentence a rule, filled from the transfer; what is not known stays visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.text import rupiah, template

from .rules import RULES

#: Fixed value: stands before every finding that rests on fixture data.
DEMONSTRATION = "DEMONSTRATION ONLY — this finding rests on fixture reference data, not on the authoritative register, and establishes nothing about the donor: "
#: Rules of these kinds read reference data, which may be a fixture.
REFERENCE_KINDS = ("register_membership", "report_reconciliation", "foreign_jurisdiction")
#: A sentence for each kind of rule; {names} are filled in.
SENTENCES = {
    "threshold": "{sender} gave {amount} to {receiver} on {date}, over the limit of {threshold} for one gift.",
    "aggregate_threshold": "With {amount} on {date}, gifts from {sender} to {receiver} pass the limit of their period.",
    "foreign_jurisdiction": "{sender}, who gave {amount} on {date}, is registered abroad.",
    "identity_absent": "{amount} reached {receiver} on {date} from a giver whose identity is not stated.",
    "register_membership": "{sender}, who gave {amount} to {receiver} on {date}, is on a register that bars gifts.",
    "report_reconciliation": "{amount} to {receiver} on {date} is in no report of its period.",
    "fan_in_burst": "Many new givers reached {receiver} before {date}; this gift is {amount}.",
    "amount_band": "{amount} on {date} lies just under the limit that applies.",
    "fan_out": "{sender} gave to many receivers before {date}; this gift is {amount}.",
    "pass_through": "{sender} passed on {amount} on {date}, about as much as had come in days before.",
    "self_funded_inflow": "{sender} declared own money for {amount} on {date}, after a large part of it had come in.",
    "velocity_spike": "{sender} gave far more often before {date} than usual; this gift is {amount}.",
    "amount_homogeneity": "Gifts to {receiver} before {date} are nearly equal; this one is {amount}.",
    "thin_donor": "{sender} had hardly any history on {date} when giving {amount}.",
    "donor_concentration": "Most of what {receiver} had by {date} is from {sender}; this gift is {amount}.",
    "deadline_clustering": "Gifts to {receiver} gather before a deadline; this one is {amount} on {date}.",
}


def statement(rule: Column, amount: Column, date: Column, sender: Column, receiver: Column, fixture: bool = True) -> Column:
    """The sentence of each rule; findings from reference data that is a ``fixture`` are marked first."""
    out = F.lit(None).cast("string")
    for r in RULES:
        limit = F.lit(None).cast("string") if r.threshold is None else rupiah(F.lit(r.threshold))
        said = template(f"{r.id}: {SENTENCES[r.kind]}", {"amount": rupiah(amount), "date": F.date_format(date, "yyyy-MM-dd"), "sender": sender, "receiver": receiver, "threshold": limit})
        out = F.when(rule == r.id, F.concat(F.lit(DEMONSTRATION), said) if fixture and r.kind in REFERENCE_KINDS else said).otherwise(out)
    return out


def explained(verdicts: DataFrame, ledger: DataFrame, fixture: bool = True) -> DataFrame:
    """(donation_id, rule_id, statement) for the verdicts that fired."""
    fired = verdicts.where(F.col("outcome").isin("LEGAL_FINDING", "BEHAVIOURAL_SIGNAL")).select("donation_id", "rule_id")
    rows = fired.join(ledger.select("donation_id", "amount_idr", "occurred_at", "sender_id", "receiver_id"), "donation_id")
    return rows.select("donation_id", "rule_id", statement(F.col("rule_id"), F.col("amount_idr"), F.col("occurred_at"), F.col("sender_id").cast("string"), F.col("receiver_id").cast("string"), fixture).alias("statement"))
