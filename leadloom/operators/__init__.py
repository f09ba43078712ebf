"""DataFrame operators: discovery, rules, brands, identity, catalogue, evidence, grounding, reads."""
