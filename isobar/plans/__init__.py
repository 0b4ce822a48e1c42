"""End-to-end plans: the applications, and the driver's queries."""
