"""clausewright: data contracts as Spark plans (profile, check, diff, attribute, report)."""
