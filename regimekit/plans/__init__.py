"""Multi-stage plans: model fitting, variants, and the registered query catalog."""
