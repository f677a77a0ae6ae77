"""Latent-state models of sequences. Parameters live on the driver, sequences never do."""
