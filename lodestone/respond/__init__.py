"""Model answers: requests, responders, the content-addressed cache, budgets, templates."""
