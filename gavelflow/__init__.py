"""A PySpark-native engine for text moderation: features, rules, risk, decisions and curation."""
