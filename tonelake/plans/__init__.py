"""Plans that run several jobs: graph components, incremental passes."""
