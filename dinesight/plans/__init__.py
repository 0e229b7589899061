"""End-to-end plans over restaurant-shaped tables."""
